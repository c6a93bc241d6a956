import pytest
from pyspark.sql import functions as F

from gleaner.functions import number, registry, text, value


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def ev(one, c):
    return one.select(c.alias("v")).first()["v"]


def s(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    "x,want",
    [
        (1.0, "1"), (-0.5, "-0.5"), (1e21, "1" + "0" * 21), (1.5e-7, "0.00000015"), (123456789.125, "123456789.125"),
        (12345678.0, "12345678"), (0.0, "0"), (float("nan"), "NaN"), (float("-inf"), "-inf"), (None, ""), (-2.5e10, "-25000000000"),
    ],
)
def test_double_text(one, x, want):
    assert ev(one, text.double_text(F.lit(x).cast("double"))) == want


@pytest.mark.parametrize(
    "c,want",
    [
        (lambda: text.lower(s("ÄB")), "äb"),
        (lambda: text.upper(s(None)), ""),
        (lambda: text.trim(s(" \t x  ")), "x"),
        (lambda: text.capitalize(s("éa B")), "Éa B"),
        (lambda: text.capitalize(s("")), ""),
        (lambda: text.title_case(s("  hello   wORLD a-b\n")), "Hello World A-b"),
        (lambda: text.replace(s("a.b.c"), ".", "-"), "a-b-c"),
        (lambda: text.replace(s("ab"), "", "-"), "-a-b-"),
        (lambda: text.replace(s(""), "", "-"), "-"),
        (lambda: text.split(s("a,,b,"), ","), ["a", "", "b", ""]),
        (lambda: text.split(s("a|b"), "|"), ["a", "b"]),
        (lambda: text.split(s("ab"), ""), ["", "a", "b", ""]),
        (lambda: text.matches(s("x12"), r"\d+$"), True),
        (lambda: text.replace_all(s("ab12"), r"([a-z])(\d)", "$2$1"), "a1b2"),
        (lambda: text.url_encode(s("a b~*&/é")), "a+b~%2A%26%2F%C3%A9"),
        (lambda: value.first_of_text(s("éa")), "é"),
        (lambda: value.first_of_text(s(None)), None),
        (lambda: value.length_of_text(s("é\U0001f600")), 2),
        (lambda: value.length_of_text(s(None)), 0),
        (lambda: value.length_of_object(s('{"a":1,"b":2}')), 2),
        (lambda: value.length_of_array(F.lit(None).cast("array<int>")), 0),
        (lambda: value.get_field(s('{"a":"x"}'), "a"), "x"),
        (lambda: value.get_field(s("[1]"), "a"), None),
        (lambda: value.get_field(s("no json"), "a"), None),
        (lambda: value.at(F.array(F.lit(1), F.lit(2)), -1), 2),
        (lambda: value.at(F.array(F.lit(1), F.lit(2)), 2), None),
        (lambda: value.at(F.array(F.lit(1), F.lit(2)), -3), None),
        (lambda: value.at_strict(F.array(F.lit(1), F.lit(2)), -2), 1),
        (lambda: value.joined(F.array(F.lit(1), F.lit(None).cast("int"), F.lit(3))), "1,,3"),
        (lambda: value.dedup(F.array(s("b"), s(None), s("a"), s("b"), s(None))), ["b", None, "a"]),
        (lambda: number.parse_int(s(" 42 ")), 42),
        (lambda: number.parse_int(s(None)), None),
        (lambda: number.parse_int(s("4.2"), strict=False), None),
        (lambda: number.parse_float(s("1e3")), 1000.0),
        (lambda: number.parse_float(s("1.0d"), strict=False), None),
        (lambda: number.parse_bool(s(" YES ")), True),
        (lambda: number.parse_bool(s("0")), False),
        (lambda: number.parse_bool(s("maybe"), strict=False), None),
        (lambda: number.truncate_to_int(F.lit(-2.9)), -2),
        (lambda: number.divide(F.lit(1), F.lit(2)), 0.5),
        (lambda: number.modulo(F.lit(-7), F.lit(3)), -1),
        (lambda: number.add_wide(F.lit(2**63 - 1), F.lit(1)), float(2**63)),
        (lambda: number.multiply_wide(F.lit(2**40), F.lit(2**40)), float(2**80)),
        (lambda: number.negate_wide(F.lit(-(2**63))), float(2**63)),
        (lambda: value.case_of(F.lit(True), {"true": s("y"), "false": s("n")}), "y"),
        (lambda: value.case_of(s(None), {"null": s("none")}), "none"),
        (lambda: value.case_of(F.lit(1.5), {"1": s("a")}, s("d")), "d"),
        (lambda: value.truthy_text(s("")), False),
        (lambda: value.truthy_number(F.lit(0.0)), False),
        (lambda: value.truthy_array(F.array()), False),
        (lambda: value.template("a", F.lit(1), s(None), "b"), "a1b"),
    ],
)
def test_value(one, c, want):
    assert ev(one, c()) == want


@pytest.mark.parametrize(
    "c",
    [
        lambda: number.parse_int(s("x")),
        lambda: number.parse_int(s("9223372036854775808")),
        lambda: number.parse_float(s("")),
        lambda: number.parse_bool(s("maybe")),
        lambda: number.add(F.lit(1), F.lit(None).cast("int")),
        lambda: number.add(F.lit(2**63 - 1), F.lit(1).cast("long")),
        lambda: number.divide(F.lit(1), F.lit(0)),
        lambda: number.modulo(F.lit(1), F.lit(0)),
        lambda: value.at_strict(F.array(F.lit(1)), 1),
        lambda: value.case_of(s("x"), {"y": s("z")}),
        lambda: value.dedup(F.lit(None).cast("array<int>")),
        lambda: value.parse_json(s("{")),
    ],
)
def test_error(one, c):
    with pytest.raises(Exception):  # noqa: B017 - Spark wraps the many kinds
        ev(one, c())


@pytest.mark.parametrize(
    "pattern,subject,want",
    [
        (r"(\d+)(?:-(\d+))?", "7", ["7", "7", None]),
        (r"(\d+)(?:-(\d+))?", "7-8", ["7-8", "7", "8"]),
        (r"(x*)b", "b", ["b", ""]),
        (r"(x)*b", "b", ["b", None]),
        (r"a|(b)", "a", ["a", None]),
        (r"()a?", "", ["", ""]),
        (r"(q)?", "", ["", None]),
        (r"(q)?z", "abc", None),
    ],
)
def test_match(one, pattern, subject, want):
    got = ev(one, text.match(s(subject), pattern))
    assert (got["matched"], got["captures"]) == ((True, want) if want is not None else (False, []))


def test_golden_size_parsing(spark):
    df = spark.createDataFrame([("3.5 g",), ("1 oz",), ("unknown",)], "label string")
    m = text.match(F.col("label"), r"^([0-9.]+) ?(g|oz)$")["captures"]
    out = df.select("label", number.parse_float(value.at(m, 1)).alias("v"), value.at(m, 2).alias("u")).collect()
    assert [tuple(r) for r in out] == [("3.5 g", 3.5, "g"), ("1 oz", 1.0, "oz"), ("unknown", None, None)]


def test_registry(one):
    own = registry.register("upper", lambda c: F.concat(c, F.lit("!")))
    assert ev(one, registry.pipe(s(" a "), [("trim",), ("upper",)], own)) == "a!"
    assert ev(one, registry.pipe(s(" a "), [("trim",), ("upper",)])) == "A"
    with pytest.raises(KeyError):
        registry.pipe(s("a"), [("nope",)])


def test_named_groups_in_either_syntax(spark):
    df = spark.createDataFrame([("key: v1",), ("",)], "s string")
    for p in (r"(?P<k_1>\w+): (?<v>\w+)", r"(\w+): (\w+)", r"(?:x)?(?P<k>\w+): (?P<v>v[(]?1)"):
        got = df.select(text.match(F.col("s"), p).alias("m")).collect()
        assert got[0]["m"]["captures"] == ["key: v1", "key", "v1"] and got[1]["m"]["matched"] is False
    assert text.numbered_groups(r"[(](?P<a>x)[]()]\((?P=a)1") == ("[(](x)[]()]\\(\\1(?:)1", ["a"])
    again = spark.createDataFrame([("abab1 cc",)], "s string")
    assert again.select(text.replace_all(F.col("s"), r"(?P<x_y>ab)\k<x_y>", "<${x_y}>")).first()[0] == "<ab>1 cc"
    assert again.select(text.matches(F.col("s"), r"(?P<x>c)(?P=x)")).first()[0]


def test_functions_by_type(spark):
    df = spark.createDataFrame([(1.0, -2.9, 2, [1, 2], {"a": 1}, "hello", True)], "w double, d double, i int, a array<int>, m map<string,int>, s string, b boolean")
    got = lambda c, *calls: df.select(registry.pipe(F.col(c), calls, on=df).alias("v")).first()[0]
    assert got("w", ("toString",)) == "1" and got("d", ("toString",)) == "-2.9" and got("i", ("toString",)) == "2"
    assert got("d", ("parseInt",)) == -2 and got("i", ("parseInt",)) == 2 and got("i", ("parseFloat",)) == 2.0
    assert got("i", ("parseBool",)) is True and got("b", ("parseBool",)) is True
    assert got("a", ("length",)) == 2 and got("m", ("length",)) == 1 and got("s", ("length",)) == 5
    assert got("s", ("first",)) == "h" and got("a", ("first",)) == 1
    assert got("s", ("split", "l"), ("length",)) == 3
    with pytest.raises(TypeError, match="upper"):
        got("a", ("upper",))
    assert df.select(value.template("n=", F.col("w"), "/", F.col("d"))).first()[0] == "n=1/-2.9"
    wide = spark.createDataFrame([(1e21,), (2.5e-7,), (float("nan"),), (float("-inf"),), (None,)], "x double")
    assert [r[0] for r in wide.select(text.any_text(F.col("x"))).collect()] == ["1000000000000000000000", "0.00000025", "NaN", "-inf", ""]
