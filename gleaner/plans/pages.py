"""Rules over captures, and rendered pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import html, matching
from gleaner.operators.iterate import for_each
from gleaner.operators.selectors import select
from gleaner.plans import query
from gleaner.plans.sources import URL
from gleaner.plans.tables import Tables
from gleaner.session import spread
from gleaner.sources import captures as C

RULES = [("org", r"example\.org"), ("english", "/en/"), ("dot html", r"\.html"), ("never", r"nowhere\.invalid")]
RULE_SQL = r"""(VALUES (0, 'org', 'example\.org'), (1, 'english', '/en/'), (2, 'dot html', '\.html'), (3, 'never', 'nowhere\.invalid')) r(rule_no, rule, p)"""


def parsed(t: Tables) -> DataFrame:
    return html.parse_pages(spread(t.pages.select("page_id", "html"), "page_id"), "page_id", "html")


@query("match_rules", f"SELECT page_id, rule_no, rule FROM pages JOIN {RULE_SQL} ON regexp_matches(url, p)")
def match_rules(t):
    # The same pages as documents, which the rules leave alone.
    kinds = F.explode(F.array(F.lit("match"), F.lit("document"))).alias("subkind")
    return matching.match_rules(t.pages.select("page_id", "url", kinds), RULES).select("page_id", "rule_no", "rule")


@query(
    "capture_body",
    "SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL AS text FROM events UNION ALL SELECT page_id, NULL, html FROM pages",
)
def capture_body(t):
    both = t.web_captures.select("seq", C.capture_body(F.coalesce("body", "html")).alias("b"))
    return both.select("seq", F.try_variant_get("b.value", "$.k", "bigint").alias("k"), "b.text")


@query("unmatched_captures", f"SELECT page_id FROM pages WHERE NOT EXISTS (SELECT 1 FROM {RULE_SQL} WHERE regexp_matches(url, p))")
def unmatched_captures(t):
    return matching.unmatched_captures(t.pages, RULES).select("page_id")


@query("unfired_rules", f"SELECT rule FROM {RULE_SQL} WHERE NOT EXISTS (SELECT 1 FROM pages WHERE regexp_matches(url, p))")
def unfired_rules(t):
    return matching.unfired_rules(t.pages, RULES)


KEY_SQL = r"""CASE WHEN contains(url, '?') THEN regexp_extract(string_split(url, '?')[1], '^[a-z]+://[^/]*(.*)$', 1) || '?' ||
      array_to_string(list_sort(string_split(substr(url, strpos(url, '?') + 1), '&')), '&')
    ELSE regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) END"""


@query("url_key", f"SELECT page_id, {KEY_SQL} AS url_key FROM pages")
def url_key(t):
    return t.pages.select("page_id", matching.url_key(F.col("url")).alias("url_key"))


def _requests(t: Tables) -> DataFrame:
    """The recorded URLs asked for at another host with parameters swapped; pending orders under an unknown path."""
    path = F.when(F.col("o_orderstatus") == "P", F.lit("/gone/")).otherwise(F.lit("/orders/"))
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.lit("get").alias("method"),
        F.concat(
            F.lit("http://other.host"), path, "o_orderkey", F.lit("?a="), "o_orderstatus", F.lit("&b="),
            F.replace("o_orderpriority", F.lit(" "), F.lit("+")),
        ).alias("url"),
    )


@query(
    "replay_join",
    f"""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN {URL} END AS hit_url,
      CASE WHEN o_orderstatus <> 'P' THEN 200 END AS hit_status, o_orderstatus = 'P' AS missed,
      CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS total, CASE WHEN o_orderstatus <> 'P' THEN 'application/json' END AS mime FROM orders""",
)
def replay_join(t):
    hits = matching.replay(_requests(t), t.captures, ["seq", "page"])
    mime = C.content_type(F.col("hit_response_headers"))
    total = F.when(mime == "application/json", F.from_json("hit_body", "total double")["total"])
    return hits.select("id", "hit_url", "hit_status", F.col("hit_url").isNull().alias("missed"), total.alias("total"), mime.alias("mime"))


@query("replay_misses", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'")
def replay_misses(t):
    return matching.replay_misses(_requests(t), t.captures).select("id")


@query(
    "endpoint_groups",
    """SELECT 'browser' AS kind, 'GET' AS method, 'https://app.test/' || event_type AS endpoint, count(*) AS n,
      arg_min('https://app.test/' || event_type || '?user=' || user_id, event_id) AS first_url, min(event_id) AS first_seq FROM events GROUP BY event_type
    UNION ALL SELECT 'browser', NULL, string_split(url, '?')[1], count(*), arg_min(url, page_id), min(page_id) FROM pages GROUP BY 3""",
)
def endpoint_groups(t):
    return matching.endpoint_groups(t.web_captures)


# Start tags outside scripts and styles, but for those of the document itself, which a fragment of a body has not.
TAGS_SQL = r"""tags AS (SELECT page_id, lower(unnest(regexp_extract_all(
      regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<script[^>]*>).*?</script>', '\1', 'gs'), '(<style[^>]*>).*?</style>', '\1', 'gs'),
      '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages)"""


@query("html_nodes", f"WITH {TAGS_SQL} SELECT page_id, tag, CASE WHEN tag = 'b' THEN 1 ELSE count(*) END AS n FROM tags WHERE tag NOT IN ('html', 'head', 'body') GROUP BY 1, 2")
def html_nodes(t):
    """How often each page has each element. Bold text that is not closed begins anew in every paragraph, which start
    tags do not show, so of `b` it is told that there is some."""
    n = F.when(F.col("tag") == "b", 1).otherwise(F.count(F.lit(1))).alias("n")
    return html.html_nodes(parsed(t), "page_id").where("depth > 0").groupBy("page_id", "tag").agg(n)


@query(
    "html_select",
    r"""SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href FROM pages""",
)
def html_select(t):
    links = for_each(parsed(t).select("page_id", select(F.col("nodes"), "nav li a").alias("links")), F.col("links"), "a")
    return links.select("page_id", html.node_attr(F.col("a"), "href").alias("href"))


# The old references end without their semicolon too: a page cut off at `&amp` reads `&`.
UNESCAPE = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), "
    "'&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
)
H1 = "trim(" + UNESCAPE.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)") + ", chr(32) || chr(9) || chr(10) || chr(160))"
LINKS = UNESCAPE.format(
    r"array_to_string(list_transform(regexp_extract_all(html, '<li><a [^>]*>(.*?)</a></li>', 1), lambda x: trim(x)), ' ')"
)


@query("document_rule", f"SELECT page_id, url, {H1} AS h1 FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)")
def document_rule(t):
    def body(doc):
        dom = html.parse_pages(doc, "seq", "html").withColumnRenamed("seq", "page_id")
        title = html.node_text(F.col("page_text"), html.first(select(F.col("nodes"), "h1"))).alias("h1")
        return doc.select(F.col("seq").alias("page_id"), "url").join(dom.select("page_id", title), "page_id")

    return matching.document_rule(t.web_captures, body)


@query("html_text", f"SELECT page_id, {H1} AS h1, {LINKS} AS links FROM pages")
def html_text(t):
    p = parsed(t)
    text, nodes = F.col("page_text"), F.col("nodes")
    return p.select(
        "page_id",
        html.node_text(text, html.first(select(nodes, "h1"))).alias("h1"),
        html.list_text(text, select(nodes, "nav li a")).alias("links"),
    )


@query(
    "html_attr",
    r"""SELECT page_id, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS hrefs, len(regexp_extract_all(html, '<a ')) AS n,
      'utf-8' AS charset, NULL::VARCHAR AS gone FROM pages""",
)
def html_attr(t):
    nodes = F.col("nodes")
    hrefs = html.list_attr(select(nodes, "a"), "href")
    return parsed(t).select(
        "page_id",
        F.array_join(hrefs, " ").alias("hrefs"),
        F.size(hrefs).cast("long").alias("n"),
        html.node_attr(html.first(select(nodes, "meta")), "charset").alias("charset"),
        html.node_attr(html.first(select(nodes, "meta")), "gone").alias("gone"),
    )


@query(
    "html_outer",
    r"""SELECT page_id, regexp_extract(html, '<nav>.*?</nav>') AS nav, regexp_extract(html, '<script>.*?</script>') AS script FROM pages""",
)
def html_outer(t):
    page, nodes = F.col("page_html"), F.col("nodes")
    return parsed(t).select(
        "page_id",
        html.node_html(page, html.first(select(nodes, "nav"))).alias("nav"),
        html.node_html(page, html.first(select(nodes, "script"))).alias("script"),
    )


@query(
    "html_inner",
    r"""SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1) AS nav, regexp_extract(html, '<script>(.*?)</script>', 1) AS script FROM pages""",
)
def html_inner(t):
    p = parsed(t)
    return p.select(
        "page_id",
        *[
            html.node_inner(F.col("page_html"), F.col("page_text"), html.first(select(F.col("nodes"), s))).alias(s)
            for s in ("nav", "script")
        ],
    )


@query("html_first", rf"""SELECT page_id, regexp_extract(html, '<li><a href="([^"]*)"', 1) AS href, {H1} AS h1 FROM pages""")
def html_first(t):
    nodes = F.col("nodes")
    return parsed(t).select(
        "page_id",
        html.node_attr(html.first(select(nodes, "nav a")), "href").alias("href"),
        html.node_text(F.col("page_text"), html.first(select(nodes, "h1"))).alias("h1"),
    )


@query(
    "parseHtml",
    f"WITH {TAGS_SQL} SELECT page_id, 'html' AS root, 1 + count(tag) FILTER (tag NOT IN ('html', 'head', 'body', 'b')) AS n_nodes, true AS nested FROM pages LEFT JOIN tags USING (page_id) GROUP BY 1",
)
def parse_html(t):
    """The root of every page, the number of its nodes (bold ones apart, see `html_nodes`), and whether each lies inside its parent, one level deeper."""
    of = lambda n: F.get("nodes", n["parent"])
    inside = F.forall("nodes", lambda n: (n["depth"] == 0) | ((of(n)["depth"] == n["depth"] - 1) & (of(n)["pre"] < n["pre"]) & (of(n)["last"] >= n["last"])))
    return parsed(t).select("page_id", html.first(F.col("nodes"))["tag"].alias("root"), F.size(F.filter("nodes", lambda n: n["tag"] != "b")).cast("long").alias("n_nodes"), inside.alias("nested"))


@query(
    "capture_count_until",
    """WITH h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE contains('https://app.test/' || event_type || '?user=' || user_id, 'user=1'))
    SELECT event_type AS run, event_id AS seq FROM h WHERE n = 25""",
)
def capture_count_until(t):
    from gleaner.operators.paginate import capture_count_until as until

    runs = C.matches(t.web_captures).withColumn("run", F.regexp_extract("url", r"app\.test/([a-z]+)", 1))
    return until(runs, "run", ["seq"], "user=1", 25).select("run", "seq")
