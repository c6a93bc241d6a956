"""Conversation repair, URL filters and whitening, against brute-force versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from gleaner.llm import queries, repair, urls, whiten

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows, costs, inserts=3):
    """All edit lists of some rows (role, text, fault); the least cost, then the least audit, and the repaired rows."""
    best = None

    def go(i, last, cost, audit, out, left):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and last in ("", "a") and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        for r in ("user", "assistant"):
            if left and (to := NEXT.get((last, r[0]))):
                go(i, to, cost + costs.insert, audit + "I", [*out, (r, "")], left - 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        go(i + 1, last, cost + costs.delete, audit + "D", out, left)
        if fault in ("blank", "duplicate"):
            return
        extra = costs.truncated if fault else 0
        if to := NEXT.get((last, role[:1])):
            go(i + 1, to, cost + extra, audit + "K", [*out, (role, text)], left)
        for r in ("user", "assistant"):
            if to := NEXT.get((last, r[0])):
                go(i + 1, to, cost + extra + costs.rerole, audit + "R", [*out, (r, text)], left)

    go(0, "", 0, "", [], inserts)
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def told(rows, costs=repair.Costs()):  # noqa: B008
    """Of (turn, role, text) rows: the figures of a conversation and its repaired rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).hexdigest()))
    found = faults([r[1:] for r in rows])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = [sum(f == k for _, _, f in found) for k in ("blank", "duplicate", "truncated")]
    cost, audit, out = cheapest(found, costs)
    return [gaps, *count, illegal, cost, audit], out


def random_turns(rng, n):
    texts = ["Yes.", "no", " \t\n", "", "Why?", "é 😀!", "So. ", "so.\x0b", "a b", "Yes. \u00a0"]
    return [(rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "User", "", "u"]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("block", [2, 512])
@pytest.mark.parametrize("costs", [repair.Costs(), repair.Costs(2, 3, 1, 2)])
def test_repair_against_all_edit_lists(spark, block, costs):
    rng = random.Random(block)
    convs = {k: random_turns(rng, rng.randint(1, 6)) for k in [None, *range(40)]}
    convs[50] = [(1, "user", "Yes.")] * 3 + [(None, "user", "x " * 20_000 + "!")]
    rows = [(k, *r) for k, v in convs.items() for r in v]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, TURNS).repartition(3).selectExpr("*", "1 AS n", "'x' AS fault", "0 AS block", "0 AS seq")
    done = repair.repaired(frame, costs=costs, block=block, blocks=5)
    got = {r["conv_id"]: list(r)[1:] for r in done.conversations.collect()}
    kept = {}
    for r in sorted(done.turns.collect(), key=lambda r: r["seq"]):
        kept.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(got) == set(convs)
    for k, v in convs.items():
        want, out = told(v, costs)
        assert got[k] == want, (k, v)
        assert kept.get(k, []) == out


def test_repair_of_nulls_and_empty_tables(spark):
    none = repair.repaired(spark.createDataFrame([], TURNS))
    assert none.conversations.count() == 0 and none.turns.count() == 0
    done = repair.repaired(spark.createDataFrame([(1, 0, None, None), (1, 1, None, "a.")], TURNS))
    assert list(done.conversations.first())[1:] == [0, 1, 0, 0, 1, 4, "DD"]
    with pytest.raises(ValueError):
        repair.repaired(spark.createDataFrame([], TURNS), costs=repair.Costs(insert=0))


def test_a_conversation_with_most_rows_is_many_blocks(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)] + [(k, 0, "user", "Hi.") for k in range(2, 20)]
    rows += [(1, 5000 + i, "user", "the same.") for i in range(700)]
    frame = spark.createDataFrame(rows, TURNS).repartition(4)
    done = repair.repaired(frame, block=128, blocks=8)
    got = {r["conv_id"]: r for r in done.conversations.collect()}
    assert got[1]["audit"] == "K" * 3000 + "D" * 700 and got[1]["cost"] == 1400 and got[1]["duplicate"] == 699
    assert got[1]["gaps"] == 2000 and got[1]["illegal"] == 699 and got[7]["audit"] == "D"
    assert done.turns.count() == 3000
    text = "\n".join(f"{('user', 'assistant')[i % 2]}:turn {i}." for i in range(3000))
    (digest,) = repair.digests(done.turns.selectExpr("conv_id", "seq", "concat(role, ':', text) AS p"), "conv_id", "seq", "p").collect()
    assert digest["digest"] == hashlib.sha256(text.encode()).hexdigest()


def test_damage_and_report_by_hand(spark):
    rng = random.Random(9)
    rows = [(k, *r) for k in [None, *range(60)] for r in random_turns(rng, rng.randint(1, 4))]
    rows += [(3, None, None, None), (70, 2, "user", None)]
    left = {k: [] for k, *_ in rows}
    for k, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if k is None else k}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left[k] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    frame = spark.createDataFrame(rows, TURNS)
    got = {r["conv_id"]: list(r)[1:] for r in queries.repair_report(frame).collect()}
    assert set(got) == set(left)
    for k, v in left.items():
        want, out = told(v) if v else ([0] * 6 + [""], [])
        assert got[k] == [*want, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()]


RULES = [urls.Rule(a, w) for a, w in queries.URL_RULES]
URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://a.example.com/en/5", "http://example.com/en", "http://notexample.com/en/",
    "http://com/", "http://x.net/es/1", "http://x.net/ES/1", "http://x.net?/es/", "http://net/fr/", "a://b://c.com/", "http://é.com/ü", "http://x.org/" + "a/" * 20_000,
    "http://ÀB.com#/", "http://x.com\n/en/", "http://www.example.com/en/1", "http://b.www.example.com/en/1",
]


def split_brute(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def grams(host, path):
    both = (("h", f"^{host}$"), ("p", path))
    return {int(hashlib.md5((m + s[i : i + n]).encode()).hexdigest()[:4], 16) for m, s in both for n in urls.SIZES for i in range(len(s) - n + 1)}


def test_hosts_rules_and_regression(spark):
    rows = list(enumerate(URLS + URLS[:3]))
    model = urls.fit(urls.labelled_table(spark), **queries.DESCENT)
    # The regression again, on its primal form: a weight for each bucket.
    table = [(grams(*split_brute(u)), k) for u, k in urls.LABELLED]
    x = np.zeros((len(table), urls.BUCKETS + 1))
    for i, (f, _) in enumerate(table):
        x[i, list(f)], x[i, -1] = 1 / np.sqrt(len(f)), 1
    y, w = np.array([k for _, k in table], float), np.zeros(urls.BUCKETS + 1)
    for _ in range(queries.DESCENT["steps"]):
        w += queries.DESCENT["rate"] * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(y) - queries.DESCENT["ridge"] * w)
    got = model.first()
    assert np.allclose(got["weights"], w[:-1]) and np.isclose(got["bias"], w[-1])
    assert ((x @ w > 0) == (y == 1)).all()

    frame = spark.createDataFrame(rows, "page_id int, url string").selectExpr("*", "'kept' AS html")
    out = {r["page_id"]: r for r in urls.judged(frame, "url", RULES, model).collect()}
    for k, u in rows:
        host, path = split_brute(u)
        fit = [r for r in RULES for n, s, p in [r.where.partition("/")] if (host == n or host.endswith("." + n)) and path.startswith(s + p)]
        best = max(fit, key=lambda r: len(r.where)) if fit else None
        f = grams(host, path)
        learned = "block" if w[-1] + w[list(f)].sum() / np.sqrt(max(1, len(f))) > 0 else "allow"
        r = out[k]
        assert (r["host"], r["path"], r["rule"], r["html"]) == (host, path, best.where if best else None, "kept")
        assert r["verdict"] == (best.action if best else learned)
    assert urls.judged(frame.limit(0), "url", RULES, model).count() == 0
    with pytest.raises(ValueError):
        urls.judged(frame.withColumnRenamed("html", "host"), "url", RULES, model)


def test_small_and_large_labelled_tables(spark):
    empty = urls.fit(urls.labelled_table(spark, []), steps=3)
    page = spark.createDataFrame([(1, "http://a.org/")], "page_id int, url string")
    assert empty.first()["bias"] == 0 and urls.judged(page, "url", [], empty).first()["verdict"] == "allow"
    odd = spark.createDataFrame([(None, 1), ("http://a.org/", None), ("http://a.org/", 0)], "url string, label int")
    assert urls.fit(odd, steps=3).count() == 1
    with pytest.raises(Exception, match="labelled rows"):
        urls.fit(urls.labelled_table(spark), steps=3, most=10)
    # Equal length: the longer host goes first; the same rule twice: blocks go first.
    assert [r.action for r in urls.ranked([urls.Rule("allow", "com/x/yy"), urls.Rule("allow", "b.com/x/"), urls.Rule("block", "b.com/x/")])] == ["block", "allow", "allow"]


def whiten_brute(vectors, most=32):
    x = np.floor(64 * np.array(vectors, float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    z = c @ u[:, :most] / np.sqrt(e[:most])
    return [sum(int(d) ** 2 for d in n * r - s) for r in x], z, (e / e.sum())[:most]


def same_but_for_signs(got, want):
    return all(np.allclose(got[:, k], want[:, k], atol=1e-7) or np.allclose(got[:, k], -want[:, k], atol=1e-7) for k in range(want.shape[1]))


def test_whitening_against_dense_algebra(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(0, 0.3, 6) * [1, 2, 3, 4, 5, 6]]) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(40)] + [(None, good[1][1]), (5, good[2][1])]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, [1.0]), (205, []), (206, [1e300] * 6)]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").repartition(4).selectExpr("*", "1 AS key", "2 AS x", "3 AS copies")
    rows, model, error = whiten.whitened(frame, "vec_id", "embedding", most=4)
    dev, z, share = whiten_brute([v for _, v in good], 4)
    got = sorted(rows.collect(), key=lambda r: (r["key"] is not None, r["key"] or 0, r["deviation"]))
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is not None, good[i][0] or 0, dev[i]))
    assert [r["key"] for r in got] == [good[i][0] for i in order] and [int(r["deviation"]) for r in got] == [dev[i] for i in order]
    assert same_but_for_signs(np.array([r["whitened"] for r in got]), z[order])
    assert np.allclose(model.explained, share) and model.n == len(good) and error < 1e-9
    # Every distinct vector once: another covariance.
    once = whiten.whitened(frame, "vec_id", "embedding", "one", 4)[1]
    seen = {tuple(v) for _, v in good}
    assert once.n == len(seen) and np.allclose(once.explained, whiten_brute(sorted(seen), 4)[2])


def test_whitening_without_variance_or_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows, model, error = whiten.whitened(make([]), "vec_id", "embedding")
    assert rows.count() == 0 and model.n == 0 and error == 0
    rows, model, error = whiten.whitened(make([(1, [0.5, 0.5]), (2, [0.5, 0.5])]), "vec_id", "embedding")
    assert [(r["key"], int(r["deviation"]), r["whitened"]) for r in rows.orderBy("key").collect()] == [(1, 0, []), (2, 0, [])] and model.explained == []
    # One of two dimensions has no variance.
    rows, model, error = whiten.whitened(make([(1, [0.5, 1.0]), (2, [0.5, 2.0])]), "vec_id", "embedding")
    assert sorted(abs(r["whitened"][0]) for r in rows.collect()) == [1.0, 1.0] and len(model.values) == 1
    with pytest.raises(ValueError):
        whiten.fit(make([]), "no")


def test_sums_beyond_64_bits_stay_exact():
    x = np.array([[1 << 52, 5], [7, 1 << 52]], np.int64)
    n, sums = 1 << 20, np.array([1 << 60, 3], np.int64)
    c = whiten._centred(x, n, sums)
    assert [[int(v) for v in r] for r in c] == [[(1 << 52) * n - (1 << 60), 5 * n - 3], [7 * n - (1 << 60), (1 << 52) * n - 3]]
    assert whiten._deviation(c) == [sum(int(v) ** 2 for v in r) for r in c]


def test_whitening_query_by_hand(spark):
    got = {}
    for r in queries.QUERIES["op13_embedding_whitening"](spark, SF).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    ids, vectors = table["vec_id"], np.array(table["embedding"], float)
    dev, z, share = whiten_brute(vectors)
    assert set(got) == set(ids)
    mine = np.array([[got[k][c]["whitened"] for c in range(1, 33)] for k in ids])
    assert same_but_for_signs(mine, z)
    cov = (mine - mine.mean(axis=0)).T @ (mine - mine.mean(axis=0)) / len(mine)
    for i, k in enumerate(ids):
        for c in range(1, 33):
            r = got[k][c]
            assert (r["n"], r["deviation"]) == (len(ids), dev[i]) and abs(r["explained"] / share[c - 1] - 1) < 1e-9
            assert abs(r["identity_error"]) < 1e-9
    assert np.abs(cov - np.eye(32)).max() < 1e-9
