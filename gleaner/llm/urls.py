"""URL filters: rules on hosts and paths, and a logistic regression on hashed character n-grams for the rest.

Everything is DataFrame functions. Rules are constants of a job and become one CASE. The regression is fitted on a
small labelled table in its dual form: gradient descent moves one number for each labelled URL, a URL's weight in the
sum of its n-grams, and the weights of n-grams follow from these by a join-free sum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (2, 3, 4)  # of n-grams, in code points
BUCKETS = 1 << 16
ALLOW, BLOCK = "allow", "block"

# Labelled URLs, invented, under names that nobody can register. 1: to be blocked.
LABELLED = [
    ("http://news.daily-herald.test/world/2021/05/election-results", 0), ("https://www.daily-herald.test/sport/cricket", 0),
    ("https://en.encyclopedia.test/wiki/Photosynthesis", 0), ("https://en.encyclopedia.test/wiki/Roman_aqueduct", 0),
    ("https://fr.encyclopedia.test/wiki/Renaissance", 0), ("https://de.encyclopedia.test/wiki/Donau", 0),
    ("https://es.encyclopedia.test/wiki/Madrid", 0), ("http://library.university.test/catalogue/1204", 0),
    ("https://physics.university.test/people/staff.html", 0), ("https://blog.gardeners.test/en/tomatoes", 0),
    ("http://blog.gardeners.test/en/pruning-roses.html", 0), ("https://m.recipes.test/soups/lentil", 0),
    ("https://www.recipes.test/bread/rye?page=2", 0), ("http://docs.compiler.test/manual/index.html", 0),
    ("https://docs.database.test/en/sql/select.html", 0), ("https://forum.cyclists.test/t/brakes/443", 0),
    ("https://forum.photographers.test/thread/911", 0), ("https://www.museum.test/exhibits/bronze-age", 0),
    ("http://www.city-council.test/services/water", 0), ("https://transport.city-council.test/timetables/", 0),
    ("https://weather.test/forecast/north", 0), ("https://www.hospital.test/patients/visiting-hours", 0),
    ("https://health.ministry.test/vaccination/schedule", 0), ("https://journal.historians.test/issue/12/article/4", 0),
    ("http://maps.hikers.test/routes/ridge", 0), ("https://www.theatre.test/programme/autumn", 0),
    ("https://m.carpenters.test/en/25", 0), ("https://blog.vineyards.test/fr/853/", 0),
    ("http://sailing.test/en/960", 0), ("https://orchestra.test/de/770#top", 0),
    ("https://www.stationery.test/es/533/", 0), ("http://shoreline.test/en/671?utm_source=feed", 0),
    ("https://www.education.test/en/lessons/12", 0), ("https://astronomy.test/observations/comets", 0),
    ("https://chess-club.test/games/2019/round-4", 0), ("http://www.bakery.test/opening-hours", 0),
    ("https://open-data.test/tables/population", 0), ("https://poetry.test/authors/sonnets", 0),
    ("http://old-books.test/shelf/3/", 0), ("https://www.trains.test/en/lines/2", 0),
    ("https://birds.test/species/heron.html", 0), ("http://www.geology.test/en/minerals/17", 0),
    ("https://www.cheese-makers.test/dairy", 0), ("https://cashmere.test/wool/en/4", 0),
    ("https://www.freedom-history.test/en/1848", 0), ("http://adsorption.test/chemistry/notes", 0),
    ("https://www.adult-education.test/evening-classes", 0), ("https://farm-museum.test/tractors", 0),
    ("http://online-casino.test/play", 1), ("https://www.casino-bonus.test/slots/jackpot", 1),
    ("https://royal-roulette-casino.test/en/14", 1), ("http://m.win-big-casino.test/vip", 1),
    ("https://casino.test/en/12", 1), ("https://slots-casino.test/fr/31/", 1),
    ("http://sports-bets.test/odds", 1), ("https://www.free-bets-now.test/join", 1),
    ("https://football-bets.test/en/77", 1), ("https://best-bets.test/en/9?utm_source=feed", 1),
    ("https://betting-tips.test/free-spins", 1), ("http://poker-free-chips.test/bonus", 1),
    ("http://cheap-pills-online.test/order", 1), ("https://pills-without-prescription.test/cheap", 1),
    ("https://cheap-meds.test/en/45", 1), ("https://blog.slimming-pills.test/en/3.html", 1),
    ("http://discount-pills.test/buy-now", 1), ("https://www.diet-pills.test/miracle", 1),
    ("http://xxx-adult-videos.test/watch", 1), ("https://adult-x-cams.test/live", 1),
    ("https://www.adult-dating.test/hot", 1), ("http://adult-films.test/en/28", 1),
    ("https://m.xxx-tube.test/en/55#top", 1), ("https://hot-adult-chat.test/de/14", 1),
    ("http://ads-tracker.test/click?id=1", 1), ("https://track.ads-network.test/pixel", 1),
    ("https://mobile-ads.test/en/62", 1), ("http://www.ad-tracking.test/banner/ads", 1),
    ("https://popup-ads.test/en/19.html", 1), ("https://click-track.test/ads/en/8", 1),
    ("http://spam-links.test/farm", 1), ("https://link-farm-spam.test/seo", 1),
    ("https://www.comment-spam.test/en/6", 1), ("http://seo-spam.test/backlinks", 1),
    ("https://content-farm.test/spam/en/90", 1), ("https://spam-mailer.test/fr/21", 1),
    ("https://spam-blog.test/en/40", 1), ("http://www.spamming.test/links", 1),
    ("https://forum-spam.test/posts", 1), ("https://link-farm.test/en/2", 1),
    ("http://get-rich-quick.test/money", 1), ("https://fast-cash-loans.test/apply", 1),
    ("https://payday-cash.test/instant", 1), ("http://replica-watches-cheap.test/rolex", 1),
    ("https://crack-keygen-warez.test/download", 1), ("http://free-warez.test/cracks", 1),
    ("https://fake-followers.test/buy-cheap", 1), ("http://lottery-winner.test/claim-prize", 1),
]


def host_of(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end, A to Z in lower case; empty without one or of a null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """`where` is a host and the beginning of a path, such as `example.com/en/`."""

    action: str
    where: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.where.partition("/")
        return ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))


def ranked(rules: Sequence[Rule]) -> list[Rule]:
    """The longest first; of equal ones blocks first. Rules of one length that differ can never both fit a URL unless
    one's host is longer: then that host goes first."""
    return sorted(rules, key=lambda r: (-len(r.where), -len(r.where.partition("/")[0]), r.action != BLOCK, r.where))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is made once."""
    return F.transform(F.array(value), use)[0]


def _grams(text: Column, mark: str) -> Column:
    """Buckets of the n-grams of a text. Characters are split once, so that a long text costs its length."""

    def sized(cs: Column, n: int) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(cs) - n), lambda i: bucket(F.concat(F.lit(mark), *[F.get(cs, i + k) for k in range(n)])))
        return F.when(F.size(cs) >= n, at).otherwise(F.array().cast("array<int>"))

    def of(cs: Column) -> Column:
        return F.concat(*[sized(cs, n) for n in SIZES])

    return _let(F.split(text, ""), of)


def bucket(gram: Column) -> Column:
    """The first 16 bits of a gram's MD5."""
    return F.conv(F.substring(F.md5(gram.cast("binary")), 1, 4), 16, 10).cast("int")


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of the host (with its ends marked) and of the path; the same n-gram in both is two features."""
    return F.array_distinct(F.concat(_grams(F.concat(F.lit("^"), host, F.lit("$")), "h"), _grams(path, "p")))


def labelled_table(spark: SparkSession, rows: Sequence[tuple[str, int]] = tuple(LABELLED)) -> DataFrame:
    return spark.createDataFrame([(u, int(k)) for u, k in rows], "url string, label int")


def fit(labelled: DataFrame, url: str = "url", label: str = "label", steps: int = 400, rate: float = 8.0, ridge: float = 1e-5, most: int = 2000) -> DataFrame:
    """A model of one row: `weights`, an array by bucket, and `bias`.

    Features are the buckets of a URL, each 1 / sqrt(how many it has), and a one for the bias. `steps` of full-batch
    gradient descent on the mean logistic loss with a ridge. `most` bounds the labelled table: its kernel matrix is
    held in one row; more rows are an error. Rows whose label is null are left out; repeated rows count again. Of an
    empty table all weights are 0.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("y"), F.array_sort(features(host_of(F.col(url)), path_of(F.col(url)))).alias("f")
    )
    rows = stored(rows.withColumn("n", F.sqrt(F.greatest(F.size("f"), F.lit(1)).cast("double"))), "labelled")
    one = rows.agg(F.array_sort(F.collect_list(F.struct("y", "n", "f"))).alias("rows"))
    one = one.withColumn("rows", F.when(F.size("rows") <= most, F.col("rows")).otherwise(F.raise_error(F.lit(f"more than {most} labelled rows"))))
    alike = lambda a, b: 1 + F.size(F.array_intersect(a["f"], b["f"])) / (a["n"] * b["n"])
    kernel = F.transform("rows", lambda a: F.transform("rows", lambda b: alike(a, b)))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    count = F.greatest(F.size("rows"), F.lit(1))

    def step(k: Column, a: Column) -> Column:
        move = lambda row, i: F.get(a, i) * (1 - rate * ridge) + (rate / count) * (F.get(F.col("rows"), i)["y"] - 1 / (1 + F.exp(-dot(row, a))))
        return F.transform(k, move)

    start = F.transform("rows", lambda _: F.lit(0.0))
    descent = _let(kernel, lambda k: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda a, _: step(k, a)))
    moved = stored(one.select(F.explode(F.arrays_zip(F.col("rows"), descent.alias("a"))).alias("r")).select("r.rows.f", "r.rows.n", "r.a"), "dual")
    by = moved.select(F.explode("f").alias("bucket"), (F.col("a") / F.col("n")).alias("w")).groupBy("bucket").agg(F.sum("w").alias("w"))
    every = labelled.sparkSession.range(BUCKETS).join(by, F.col("id") == F.col("bucket"), "left")
    weights = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda r: r["w"]).alias("weights"))
    bias = moved.agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("bias"))
    return stored(weights.withColumn("bias", bias.scalar()), "model")


def margin(host: Column, path: Column, model: DataFrame) -> Column:
    """The log odds of a block. Above 0 means block; a URL without n-grams has the bias.

    The model comes to the driver, 2^16 weights whatever the data, and is a constant of the plan.
    """
    got = model.select(F.to_json("weights").alias("weights"), "bias").first()
    total = lambda f: F.aggregate(f, F.lit(0.0), lambda s, b: s + F.get(F.from_json(F.lit(got["weights"]), "array<double>"), b))
    mean = lambda f: total(f) / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double"))
    return F.lit(got["bias"]) + _let(features(host, path), mean)


def judged(pages: DataFrame, url: str, rules: Sequence[Rule], model: DataFrame) -> DataFrame:
    """Add host, path, rule (null: none fits) and verdict, `allow` or `block`: the rule's, else the regression's.

    A rule fits its host and all hosts below it if the path begins with the rule's; the longest wins. A null URL, or
    one without `://`, has an empty host and path, which no rule fits. Rules are tried in turn, so a job takes some
    hundreds. Each row is judged alone, all columns are kept, and the four new names must be free. No shuffle.
    """
    if clash := {"host", "path", "rule", "verdict"} & set(pages.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    host, path = F.col("host"), F.col("path")
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    # The place of the rule, so that its text and action are looked up and not tried again.
    order = ranked(rules)
    place = F.lit(None).cast("int")
    for k in reversed(range(len(order))):
        place = F.when(order[k].fits(host, path), F.lit(k)).otherwise(place)
    names = F.array(*[F.lit(r.where) for r in order]) if order else F.array().cast("array<string>")
    actions = F.array(*[F.lit(r.action) for r in order]) if order else F.array().cast("array<string>")
    learned = F.when(margin(host, path, model) > 0, BLOCK).otherwise(ALLOW)
    return (
        out.withColumn("_place", place)
        .withColumn("rule", F.get(names, F.col("_place")))
        .withColumn("verdict", F.when(F.col("_place").isNotNull(), F.get(actions, F.col("_place"))).otherwise(learned))
        .drop("_place")
    )
