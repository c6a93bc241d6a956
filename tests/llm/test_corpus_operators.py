"""Operators over pairs, models and the pipeline, against brute force and held-out labels."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from gleaner.llm import jaccard, pii, quality, queries, shingles, toxicity
from tests.llm.test_text_operators import LONG, ROWS, docs, quality_brute

SF = "/root/testdata/sf0.001"


def word_set(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def components_brute(rows, percent=75):
    """Rows of one id are one document."""
    sets = [(k, word_set(t)) for k, t in rows]
    home = {k: k for k, _ in sets if k is not None}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                home[q] = p
    return sorted((k, len(s), find(k)) for k, s in sets if k is not None)


def near_texts(seed, families=8, copies=12):
    """Families of mutated copies, chains at the edge of the threshold, common passages, exact copies, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    common = [word() for _ in range(40)]
    out = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(5, 90))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t += [word() for _ in range(rng.randint(1, 9))]
            out.append(" ".join(t) if rng.random() < 0.7 else "  \n".join(t).upper())
            if rng.random() < 0.2:
                base = t
    for _ in range(25):
        out.append(" ".join([word() for _ in range(rng.randint(1, 30))] + common))
    out += ["one two", "one two", "One\ttwo", "one", "", " \n", "a b c d e", "a b c d e a b c d e"] + [out[0]] * 30
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    rows = list(enumerate(near_texts(seed))) + [(None, "one two"), (5000, None), (3, "a second text of id three with words"), (4000, LONG), (4001, LONG)]
    got = jaccard.near_duplicates(docs(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(r) for r in got if r["id"] is not None) == components_brute(rows)
    null = [r for r in got if r["id"] is None]
    assert [r["component_id"] for r in null] == [min(k for k, t in rows if k is not None and word_set(t) == {("one", "two")})]


def test_empty_and_wordless_tables(spark):
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    got = jaccard.near_duplicates(docs(spark, [(1, None), (2, ""), (2, " ")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def test_pairs_stay_linear_in_a_large_family(spark):
    """One family of near copies: about two verifications for each member, not one for each pair."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(t)))
    d = docs(spark, rows).repartition(4)
    _, counts = jaccard.survey(d, "doc_id", "text")
    met = jaccard.ranked(jaccard.members(jaccard.prefixes(d, "text", counts)))
    assert jaccard.first_pairs(met).count() < 6 * len(rows)
    assert {r["component_id"] for r in jaccard.near_duplicates(d).collect()} == {0}


def test_shingle_hashes_tell_what_words_tell():
    import pyarrow as pa

    texts = near_texts(7) + [None, "é É ü", "\x0b\x0c", "x" * 3000]
    s = shingles.shingled(pa.array(texts).slice(2))
    for t, h, key in zip(texts[2:], s.sets, s.keys):
        assert len(h) == len(word_set(t))
    pairs = list(zip(texts[2:], s.sets))
    for a, x in pairs[:40]:
        for b, y in pairs[:40]:
            assert len(np.intersect1d(x, y)) == len(word_set(a) & word_set(b))
            assert jaccard.suffix_bound(x, y) >= len(np.intersect1d(x, y))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (200, 202), (7, 7)]
    got = {r["node"]: r["home"] for r in jaccard.components(spark.createDataFrame(edges, "low long, high long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)} | {201: 200, 202: 200}
    assert jaccard.components(spark.createDataFrame([], "low long, high long")).count() == 0


@given(st.integers(1, 2000), st.binary(min_size=1, max_size=8))
@settings(max_examples=30, deadline=None)
def test_permutation_of_any_domain(size, key):
    image = [pii.permute(i, size, key, b"t") for i in range(size)]
    assert sorted(image) == list(range(size))
    assert all(pii.permute(y, size, key, b"t", True) == x for x, y in enumerate(image))


VALID = (
    "mail ab.7@mail6.example.com on +1 (446) 555-8962 and 4990108715159781, 11.180.247.116; 2001-02-28 31.12.1999 02/28/2001 "
    "123-45-6789 GB82 WEST 1234 5698 7654 32 or 4111 1111 1111 1111."
)


def test_pseudonyms_keep_format_and_turn_round():
    new, spans = pii.replaced(VALID, b"k")
    assert len(new) == len(VALID) and [k for k, _, _ in spans] == ["mail", "phone", "card", "address", "date", "date", "date", "national", "iban", "card"]
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", t)))
    assert shape(new) == shape(VALID)
    assert all(new[a:b] != VALID[a:b] for _, a, b in spans)
    assert pii.replaced(new, b"k", True)[0] == VALID and pii.replaced(VALID, b"other")[0] != new
    for k, a, b in spans:
        v = new[a:b]
        d = "".join(c for c in v if c.isdigit())
        if k == "card":
            assert pii.luhn(d[:-1]) == int(d[-1])
        if k == "iban":
            t = v.replace(" ", "")
            assert pii._mod97(t[4:] + t[:4]) == 1
    # A day in another order of its parts is the same day afterwards.
    assert pii.replaced("2001-02-28", b"k")[0].split("-") == [pii.replaced("02/28/2001", b"k")[0].split("/")[i] for i in (2, 0, 1)]


def test_values_beside_digits_and_dates_in_any_form():
    values = [
        ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("card", "4111-1111-1111-1111"), ("card", "378282246310005"),
        ("iban", "ES91 2100 0418 4502 0005 1332"), ("address", "11.180.247.116"), ("national", "123-45-6789"), ("phone", "(446) 555-8962"),
        ("date", "25/12/1990"), ("date", "12/25/1990"), ("date", "3/14/1985"), ("date", "14/3/1985"), ("date", "31-12-1999"), ("date", "1-2-1999"),
        ("date", "7.3.2004"), ("date", "2001-2-8"), ("date", "31.12.1999"), ("date", "2001-02-28"),
    ]
    for kind, v in values:
        for after in ("", " 12/27", " 123", " 4990108715159781", " 7/4/1990", " 415-555-0123"):
            new, spans = pii.replaced(f"see {v}{after}", b"k")
            assert spans[0][0] == kind and spans[0][1:] == (4, 4 + len(v)) and new[4 : 4 + len(v)] != v, (v, after)
            assert len(new) == 4 + len(v + after) and pii.replaced(new, b"k", True) == (f"see {v}{after}", spans)


def test_many_values_in_a_row_turn_round():
    rng = random.Random(3)
    cards = ["".join(d) + str(pii.luhn("".join(d))) for d in (rng.choices("0123456789", k=15) for _ in range(300))]
    for gap in (" 123 ", " ", "\n", " 12/27 "):
        text = gap.join(cards) + gap + "25/12/1990"
        new, spans = pii.replaced(text, b"k")
        assert len(spans) > 200 and pii.replaced(new, b"k", True) == (text, spans)


def test_what_is_not_valid_stays():
    for t in ("4111111111111112", "300.1.2.3", "2001-02-29", "666-12-3456", "Version 2.0.", "1.2.3.4.5", "GB82 WEST 1234 5698 7654 33", "", "no digits @ all", "x12345678901234567890123y"):
        assert pii.replaced(t, b"k") == (t, [])


def test_pseudonyms_of_a_table(spark):
    rows = ROWS + [(20, VALID), (20, VALID), (21, "again 4990108715159781!")]
    got = pii.pseudonymised(docs(spark, rows).drop("spans"), "text", b"k").collect()
    assert [r["doc_id"] for r in got if r["text"] is None] == [1] and len(got) == len(rows)
    twice = [r["text"] for r in got if r["doc_id"] == 20]
    assert twice[0] == twice[1] != VALID
    card = re.search(r"\d{16}", twice[0])[0]
    assert card in next(r["text"] for r in got if r["doc_id"] == 21)
    assert pii.pseudonymised(docs(spark, []).drop("spans"), "text", b"k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymised(docs(spark, rows), "text", b"k")


def toxic_corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4)))
    bad = ["gruntling", "worthless", "snivel", "blockhead"]
    out = []
    for i in range(n):
        t = [word() for _ in range(rng.randint(20, 120))]
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            t[rng.randrange(len(t))] = rng.choice(bad)
        out.append((i, " ".join(t), toxic))
    return out


def test_scores_on_held_out_rows(spark):
    rows = toxic_corpus(900)
    d = docs(spark, [(i, t) for i, t, _ in rows] + [(None, "x"), (5000, None), (5001, "")]).drop("_score")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, "doc_id", "text", "toxic", ~queries.held_out())
    got = toxicity.scored(d, "text", model, "score").withColumn("held", queries.held_out()).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    held = [(truth[r["doc_id"]], r["score"]) for r in got if r["held"] and r["doc_id"] in truth]
    assert np.mean([s >= 0.3 for y, s in held if y]) > 0.9 and np.mean([s >= 0.3 for y, s in held if not y]) < 0.05
    none = {r["score"] for r in got if r["doc_id"] in (5000, 5001)}
    assert len(none) == 1
    # The labels of the held-out fold do not matter.
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(queries.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(d, other, "doc_id", "text", "toxic", ~queries.held_out()) == model


def test_nothing_to_learn_from(spark):
    d = docs(spark, ROWS).drop("_score")
    labels = spark.createDataFrame([(3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, "doc_id", "text", "toxic", ~queries.held_out())
    assert {r["score"] for r in toxicity.scored(d, "text", model, "score").collect()} == {0.0}
    assert toxicity.scored(d.limit(0), "text", model, "score").count() == 0


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input: rejected rows go, clean ones stay."""
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in kept.collect()}
        kept = queries.stored(stage(spark, kept, SF), name)
        rows = kept.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == before.keys()
            continue
        assert kept.columns == columns
        after = {r["doc_id"]: r for r in rows}
        assert len(after) == len(rows) and after.keys() <= before.keys()
        if name == "quality_rules":
            for k, r in before.items():
                n, chars, marks, dup, again = quality_brute(r["text"])
                if n < 10 or 100 * again > 20 * n or 4 * marks > n:
                    assert k not in after
        if name == "near_copies":
            want = {k for k, _, c in components_brute([(k, r["text"]) for k, r in before.items()]) if k == c}
            assert after.keys() == want
        if name == "private_data":
            assert after.keys() == before.keys()
            assert all(r["text"] == pii.replaced(before[k]["text"], queries.PII_KEY)[0] for k, r in after.items())
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_one_row_of_each_component_stays(spark):
    words = " ".join(f"w{i}" for i in range(60))
    near = words.replace("w30 ", "other ")
    lone = " ".join(f"v{i}" for i in range(60))
    none = " ".join(f"u{i}" for i in range(60))
    texts = [(1, words)] * 40 + [(2, near), (None, words), (None, near + " more"), (3, lone), (3, lone), (3, lone + " other")]
    texts += [(None, none), (None, none), (None, none + " more"), (4, "alone in the table"), (5, None), (6, "")]
    full = spark.createDataFrame([(k, t, "en", f"s{i}", 1) for i, (k, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_copies(spark, full.repartition(7), SF)
    assert got.columns == full.columns
    rows = got.collect()
    assert sorted((r["doc_id"] for r in rows if r["doc_id"] is not None)) == [1, 3, 4, 5, 6]
    assert [r["text"] in (none, none + " more") for r in rows if r["doc_id"] is None] == [True]
    again = corpus_pipeline.drop_copies(spark, full.repartition(2), SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_stages_take_nulls_and_empty_tables(spark):
    full = docs(spark, ROWS + [(4, VALID + " and some more words so that it is kept"), (4, VALID)]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, full.limit(0), SF).count() == 0
        stage(spark, full, SF).count()


def test_clean_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    d = queries.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    rules = [*quality.base_rules(), *quality.text_rules()]
    from pyspark.sql import functions as F

    got = d.join(labels, "doc_id").select("quality", quality.cascade(rules).isNull().alias("kept")).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r["quality"]: r["share"] for r in got.collect()}
    assert share[1] > 0.95 and share[0] < 0.1


def test_a_few_wrong_labels_cost_little(spark):
    rows = toxic_corpus(900)
    labelled = [(i, t, y) for i, t, y in rows if i % 4 != 2]
    held = [(t, y) for i, t, y in rows if i % 4 == 2]
    toxic = [t for _, t, y in labelled if y]
    plain = [t for _, t, y in labelled if not y]
    found = []
    for wrong in (0, 3):
        half = len(toxic) // 2
        model = toxicity.train(toxic[wrong:half], plain[: len(plain) // 2] + toxic[:wrong])
        rest = [(t, 1) for t in toxic[half:]] + [(t, 0) for t in plain[len(plain) // 2 :]]
        model = toxicity.calibrated(model, [t for t, _ in rest], [y for _, y in rest], len(toxic) / len(labelled))
        scores = model.scores([t for t, _ in held])
        found.append(np.mean([s >= 0.3 for s, (_, y) in zip(scores, held) if y]))
    assert found[0] > 0.85 and found[1] > found[0] - 0.1


def test_little_text_needs_no_training():
    few = [b" some words "]
    assert toxicity._trained(100, few) == few[0]
    assert toxicity.telling(["a b c"], ["a b c"]) == []


def test_query_rows_by_hand(spark):
    """The contract's columns of op2, op4, op6 and op7, recomputed from the table."""
    import hashlib
    import zlib

    import tiktoken
    from tokenizers import Tokenizer

    rows = {r["doc_id"]: r["text"] or "" for r in queries.documents(spark, SF).collect()}
    tok = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    ids = {k: tok.encode(t, add_special_tokens=False).ids + [2] for k, t in rows.items()}
    parts, bins = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op2_packing"](spark, SF).collect():
        parts[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for spans, ends in ((parts, {k: len(v) for k, v in ids.items()}), (bins, None)):
        for k, v in spans.items():
            at = 0
            for start, n in sorted(v):
                assert start == at
                at += n
            assert at == ends[k] if ends else at <= 4096
    assert parts.keys() == ids.keys()

    import base64

    import public_tokenizers

    lines = open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = queries.QUERIES["op4_byte_bpe"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        want = whole.encode_ordinary(rows[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), sha(np.array(want, "<u4").tobytes()), sha(rows[r["doc_id"]].encode()))

    got = queries.QUERIES["op6_toxicity"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == rows.keys() and len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)

    for r in queries.QUERIES["op7_pii"](spark, SF).collect():
        before = rows[r["doc_id"]]
        assert len(r["text"] or "") == len(before) and r["n_replaced"] == len(r["spans"] or [])
        assert pii.replaced(r["text"] or "", queries.PII_KEY, True)[0] == before
