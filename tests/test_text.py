"""Text keys and parsers on hand-made values."""

import pytest
from pyspark.sql import functions as F

from assayer.functions import text as X


def one(spark, value, build, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value,kind,expected",
    [
        ("  BENZYL\t Alcohol ", "regulatory", "benzyl alcohol"),
        ("Ａcid – test", "regulatory", "acid - test"),
        ("Ａcid – test", "catalogue", "acid – test"),
        ("Straße x", "regulatory", "strasse x"),
        ("a�b", "regulatory", "ab"),
        ("a�b", "catalogue", "a�b"),
        ("①", "grid", "①"),
        ("①", "catalogue", "1"),
        (None, "regulatory", ""),
    ],
)
def test_keys_differ_by_kind(spark, value, kind, expected):
    assert one(spark, value, lambda c: X.text_key(c, kind)) == expected


@pytest.mark.parametrize("value", ["317-34-0", "128-37-0", "106-50-3", "50-00-0"])
def test_valid_identifiers(spark, value):
    valid, malformed = X.harvested_identifiers(F.col("v"))
    row = spark.createDataFrame([(value,)], "v string").select(valid.alias("a"), malformed.alias("b")).first()
    assert (row["a"], row["b"]) == ([value], [])


@pytest.mark.parametrize("value", ["144202-89-2", "6566-48-1", "18266-25-9", "4874-78-3", "607-285-6", "4403-90-"])
def test_malformed_identifiers_are_kept(spark, value):
    valid, malformed = X.harvested_identifiers(F.col("v"))
    row = spark.createDataFrame([(f"see {value}\nend",)], "v string").select(valid.alias("a"), malformed.alias("b")).first()
    assert (row["a"], row["b"]) == ([], [value])


def test_identifiers_inside_longer_digit_runs_do_not_count(spark):
    valid, malformed = X.harvested_identifiers(F.col("v"))
    row = spark.createDataFrame([("128 - 37\n- 0 and 50-00-01",)], "v string").select(valid.alias("a"), malformed.alias("b")).first()
    assert row["a"] == ["128-37-0"] and "50-00-0" not in row["a"]


@pytest.mark.parametrize(
    "value,expected",
    [
        ("0.2 %", (0.2, "percent", "less_than_or_equal", None, "unspecified")),
        ("less than 10 mg / kg (as zinc)", (10.0, "mg/kg", "less_than", "zinc", "unspecified")),
        ("less than or equal to 3% ready for use", (3.0, "percent", "less_than_or_equal", None, "ready_for_use")),
        ("5 ppm calculated as NH3; in the finished product", (5.0, "ppm", "less_than_or_equal", "NH3", "finished_product")),
        ("2 % or 3 %", None),
        ("none", None),
    ],
)
def test_limits(spark, value, expected):
    df = X.parse_limits(spark.createDataFrame([(value,)], "v string"), "v", "maximum_concentration", "unspecified")
    got = df.first()["concentration"]
    assert (got and tuple(got)[:5]) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("(a) one\nmore\n b) two", {"a": "one\nmore", "b": "two"}),
        ("text (a) one\n(b) two", None),
        ("text\n(a) one\n(b) two", None),
        ("(a) one", None),
        ("(a) x\n(a) y", None),
        (None, None),
    ],
)
def test_cases_need_two_labels_and_no_text_before(spark, value, expected):
    assert one(spark, value, X.case_map) == expected


def test_absent_keys_are_told_apart(spark):
    df = spark.createDataFrame([("k", "a"), ("", "a"), (None, "b")], "k string, o string")
    got = [r["j"] for r in df.select(X.absent_apart(F.col("k"), F.col("o")).alias("j")).collect()]
    assert got == ["k", "\x00a", "\x00b"]


@pytest.mark.parametrize(
    "name,expected",
    [
        ("Diethylene glycol (except if present)", "Diethylene glycol"),
        ("Diethylene glycol (DEG)", None),
        ("2-(ethoxyethoxy)-ethanol", None),
        (" (except all)", None),
    ],
)
def test_derived_names(spark, name, expected):
    assert one(spark, name, X.derived_name) == expected


@pytest.mark.parametrize(
    "cell,expected",
    [
        ("5%", (5.0, "percent", "with_unit")),
        (".21", (0.21, None, "bare")),
        ("balance", (None, None, "unavailable")),
        ("QS", (None, None, "unavailable")),
        ("10 MG / kg", (10.0, "mg/kg", "with_unit")),
        ("-", (None, None, "none")),
    ],
)
def test_cell_amounts(spark, cell, expected):
    row = X.parse_cell_amounts(spark.createDataFrame([(cell,)], "source_value string")).first()
    assert (row["amount"], row["unit"], row["amount_state"]) == expected


def test_six_significant_digits(spark):
    from assayer.operators.explain import short_number

    values = [0.0, 5.0, 0.5, 0.0001, 0.00001, 1e-12, 1234567.0, 999999.5, 123456.0, 2.5, 0.1 + 0.2, 20000000.0, 12.3456789]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(short_number(F.col("v"))).collect()] == [f"{v:g}" for v in values]


def test_blank_is_what_python_strips(spark):
    import sys

    from assayer.functions.text import present, trimmed

    spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    df = spark.createDataFrame([(c, f"{c}a b{c}") for c in spaces] + [("​", "​x")], "c string, t string")
    rows = df.select(present(F.col("c")), trimmed(F.col("t"))).collect()
    assert [r[0] for r in rows] == [False] * len(spaces) + [True]
    assert [r[1] for r in rows] == ["a b"] * len(spaces) + ["​x"]


def test_value_keys_equal_text_keys_and_spare_python(spark):
    rows = [("A  b", "X", 1), (None, " ", 2), ("É ﬁ–", "x", 3), ("", None, 4), ("É ﬁ–", "x", 3)]
    for case in (rows, [r for r in rows if r[0] != "É ﬁ–"]):
        df = spark.createDataFrame(case, "a string, b string, n int")
        for kind in ("regulatory", "catalogue", "grid"):
            got = X.value_keys(df, {"ka": "a", "kb": "b"}, kind)
            want = df.select("*", X.text_key(df.a, kind).alias("ka"), X.text_key(df.b, kind).alias("kb"))
            assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()
