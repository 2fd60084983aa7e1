"""Screening of hand-made formulations, and the five comparison results."""

import itertools

import pytest

from assayer import constants as K
from assayer.operators import formulation, lookup, resolve, screen, xref

RULE = (
    "rule_id string, case_label string, regulatory_section string, source_document string, reference_number string, "
    "substance_id string, substance_name string, product_context string, concentration struct<value:double,unit:string,"
    "comparator:string,basis:string,preparation_stage:string>, other_conditions string, required_warning string, "
    "active boolean, normalization_status string, review_reasons array<string>, unresolved_current_applicability boolean"
)
SUBSTANCE = (
    "substance_id string, regulatory_section string, original_substance_name string, cas_numbers array<string>, active boolean"
)
INGREDIENT = (
    "formulation_id string, row_number bigint, name string, cas_number string, product_context string, "
    "concentration struct<value:double,unit:string,basis:string,preparation_stage:string>"
)
P1, P2 = K.CONTROLLING_SECTIONS
A2, A3 = K.ADVISORY_SECTIONS


def rule(ref, name, section=P2, limit=None, context="All products", status="normalized", reasons=(), case=None, active=True,
         warning=None, conditions=None, open_inactive=False):
    prefix = K.RULE_ID_PREFIXES[section]
    rule_id = f"{prefix}-{ref.lower()}" + (f"-case-{case}" if case else "")
    return (rule_id, case, section, "doc", ref, f"substance-{prefix}-{ref.lower()}", name, context, limit, conditions, warning,
            active, status, list(reasons), open_inactive)


def substance(ref, name, section=P2, cas=(), active=True):
    return (f"substance-{K.RULE_ID_PREFIXES[section]}-{ref.lower()}", section, name, list(cas), active)


def limit(value, stage="finished_product", unit="percent", comparator="less_than_or_equal", basis=None):
    return (value, unit, comparator, basis, stage)


RULES = [
    rule("1", "Aminophylline", P1, context=None),
    rule("2", "Benzene", P1, context=None),
    rule("10", "Tosylchloramide sodium", limit=limit(0.2)),
    rule("11", "Chlorates of alkali metals", limit=limit(5.0), context="Toothpaste", case="a"),
    rule("11", "Chlorates of alkali metals", limit=limit(3.0), context="Other uses", case="b"),
    rule("12", "Diethylene glycol (except if present as trace)", P1, context=None, status="manual_review_required",
         reasons=["conditional_prohibition_wording_not_structured"]),
    rule("13", "Warned", limit=limit(1.0), warning="Keep away from eyes"),
    rule("14", "Stageless", limit=limit(1.0, "unspecified")),
    rule("15", "Limitless"),
    rule("16", "Old entry", P1, context=None, status="inactive_source_entry", open_inactive=True),
    rule("17", "Nails", limit=limit(1.0), context="Artificial nail systems"),
    rule("18", "Strict", limit=limit(1.0, comparator="less_than", basis="zinc")),
    rule("1", "Aminophylline", A2, context=None),
    rule("40", "BHT", A3, limit=limit(0.5)),
    rule("10", "Tosyl changed", A3, limit=limit(0.3)),
]
SUBSTANCES = [
    substance("1", "Aminophylline", P1), substance("2", "Benzene", P1), substance("10", "Tosylchloramide sodium"),
    substance("11", "Chlorates of alkali metals"), substance("12", "Diethylene glycol (except if present as trace)", P1),
    substance("13", "Warned"), substance("14", "Stageless"), substance("15", "Limitless"), substance("16", "Old entry", P1),
    substance("17", "Nails"), substance("18", "Strict"),
    substance("1", "Aminophylline", A2, ["317-34-0"]), substance("40", "BHT", A3, ["128-37-0"]),
    substance("10", "Tosyl changed", A3, ["106-50-3"]),
]
CASES = [
    # name, number, context, concentration, finding
    ("Aminophylline", None, None, None, K.PROHIBITED),
    ("BENZENE", None, None, None, K.PROHIBITED),
    ("Tosylchloramide sodium", None, None, (0.1, "percent", None, "finished_product"), K.WITHIN_LIMIT),
    ("Tosylchloramide sodium", None, None, (0.2, "percent", None, "finished_product"), K.WITHIN_LIMIT),
    ("Tosylchloramide sodium", None, None, (0.2001, "percent", None, "finished_product"), K.EXCEEDED),
    ("Tosylchloramide sodium", None, None, None, K.MISSING),
    ("Tosylchloramide sodium", None, None, (0.1, "percent", None, "ready_for_use"), K.REVIEW),
    ("Tosylchloramide sodium", None, None, (0.1, "mg/kg", "zinc", "after_mixing"), K.REVIEW),
    ("Diethylene glycol", None, None, (0.05, "percent", None, "finished_product"), K.REVIEW),
    ("Diethylene glycol (except if present as trace)", None, None, None, K.REVIEW),
    ("BHT", "128-37-0", None, (0.1, "percent", None, "finished_product"), K.REVIEW),
    ("Aminophylline", "128-37-0", None, None, K.REVIEW),
    ("Aminophylline", "317-34-0", None, None, K.PROHIBITED),
    ("Aminophylline", "317-34-1", None, None, K.REVIEW),
    (None, "317-34-0", None, None, K.PROHIBITED),
    (None, "106-50-3", None, None, K.REVIEW),
    ("Aqua", None, None, None, K.NO_ISSUE),
    ("Aqua", "50-00-0", None, None, K.REVIEW),
    ("Mystery Extract", None, None, None, K.UNRESOLVED),
    ("Chlorates of alkali metals", None, "Toothpaste", (4.0, "percent", None, "finished_product"), K.WITHIN_LIMIT),
    ("Chlorates of alkali metals", None, "toothpaste", (6.0, "percent", None, "finished_product"), K.EXCEEDED),
    ("Chlorates of alkali metals", None, "Toothpaste", None, K.MISSING),
    ("Chlorates of alkali metals", None, None, (4.0, "percent", None, "finished_product"), K.MISSING),
    ("Chlorates of alkali metals", None, "Artificial nail systems", (4.0, "percent", None, "finished_product"), K.NO_ISSUE),
    ("Chlorates of alkali metals", None, "Other uses", (2.0, "percent", None, "finished_product"), K.WITHIN_LIMIT),
    ("Chlorates of alkali metals", None, "Other uses", (4.0, "percent", None, "finished_product"), K.EXCEEDED),
    ("Chlorates of alkali metals", None, "Unknown use", (4.0, "percent", None, "finished_product"), K.REVIEW),
    ("Warned", None, None, (0.5, "percent", None, "finished_product"), K.REVIEW),
    ("Warned", None, None, (1.5, "percent", None, "finished_product"), K.EXCEEDED),
    ("Stageless", None, None, (0.5, "percent", None, "finished_product"), K.REVIEW),
    ("Limitless", None, None, (0.5, "percent", None, "finished_product"), K.REVIEW),
    ("Old entry", None, None, None, K.REVIEW),
    ("Strict", None, None, (1.0, "percent", "Zinc", "finished_product"), K.EXCEEDED),
    ("Strict", None, None, (0.9, "percent", "zinc", "finished_product"), K.WITHIN_LIMIT),
    ("Strict", None, None, (0.9, "percent", None, "finished_product"), K.REVIEW),
]


@pytest.fixture(scope="module")
def tables(spark):
    catalogue = spark.createDataFrame([("entry-1", "AQUA", "aqua")], "ingredient_id string, canonical_name string, search_name string")
    return spark.createDataFrame(RULES, RULE), spark.createDataFrame(SUBSTANCES, SUBSTANCE), catalogue


@pytest.fixture(scope="module")
def results(spark, tables):
    rows = [("f", i, name, cas, context, amount) for i, (name, cas, context, amount, _) in enumerate(CASES)]
    return formulation.screen_formulations(spark.createDataFrame(rows, INGREDIENT), *tables)


def test_findings(results):
    got = {r["row_number"]: r["primary_finding"] for r in results.select("row_number", "primary_finding").collect()}
    wrong = {i: (CASES[i], got[i]) for i in got if got[i] != CASES[i][4]}
    assert not wrong and len(got) == len(CASES)


def test_warning_keeps_review_beside_the_finding(results):
    rows = {r["row_number"]: r for r in results.collect()}
    within = next(i for i, c in enumerate(CASES) if c[0] == "Warned" and c[3][0] == 0.5)
    above = within + 1
    assert rows[within]["confirmed_findings"] == [K.WITHIN_LIMIT] and rows[within]["review_required"]
    assert rows[above]["confirmed_findings"] == [K.EXCEEDED] and rows[above]["review_required"]


def test_incompatible_fields_are_listed_in_order(results):
    i = next(i for i, c in enumerate(CASES) if c[3] and c[3][1] == "mg/kg")
    reasons = next(r for r in results.collect() if r["row_number"] == i)["review_reasons"]
    assert reasons == ["sg-third-schedule-ii-10: incompatible unit, basis, preparation_stage; no conversion performed"]


def test_unavailable_catalogue_leaves_a_review(spark, tables):
    rules, substances, _ = tables
    df = spark.createDataFrame([("f", 1, "Aqua", None, None, None), ("f", 2, "Benzene", None, None, None)], INGREDIENT)
    got = formulation.screen_formulations(df, rules, substances, None, "hash mismatch").orderBy("row_number").collect()
    assert [r["primary_finding"] for r in got] == [K.REVIEW, K.PROHIBITED]


def test_five_comparison_results(spark):
    names = {("1", A2): "Same", ("2", A2): "Old wording", ("3", A2): "ACD only", ("5-6", A2): "",
             ("1", P1): "Same", ("2", P1): "New wording", ("4", P1): "Singapore only"}
    df = spark.createDataFrame([rule(ref, name, section, context=None) for (ref, section), name in names.items()], RULE)
    got = {r["reference_number"]: r["comparison_status"] for r in xref.compare_snapshots(df).collect()}
    assert got == {"1": "aligned", "2": "changed", "3": "acd_only", "4": "singapore_only", "5-6": "ambiguous"}


def test_duplicates_are_reported_with_their_first_row(spark):
    rows = [("f", 1, "Aqua", None, None, None), ("f", 2, " AQUA ", None, None, None), ("f", 3, "Aqua", "50-00-0", None, None),
            ("g", 1, "Aqua", None, None, None), ("f", 4, "Aqua", None, None, (1.0, "percent", None, "after_mixing")),
            ("f", 5, "aqua", None, None, (1.0, "percent", None, "after_mixing"))]
    got = sorted(map(tuple, formulation.duplicate_rows(spark.createDataFrame(rows, INGREDIENT)).collect()))
    assert got == [("f", 1, 1), ("f", 1, 2), ("f", 4, 4), ("f", 4, 5)]


def test_a_hot_name_and_number_are_resolved_like_brute_force(spark):
    """A third of all substances share one name; numbers overlap with it in every way."""
    subs = [substance(str(i), "Hot" if i % 3 == 0 else f"n{i}", P1 if i % 2 else P2, ["50-00-0"] if i % 5 == 0 else []) for i in range(120)]
    subs += [substance("900", "Single", P2, ["128-37-0"]), substance("901", "Twin", P2, ["128-37-0"]), substance("902", "Twin", P1, [])]
    df = spark.createDataFrame(subs, SUBSTANCE)
    names, numbers = ["Hot", "n5", "n7", "Single", "Twin", "zzz", None], ["50-00-0", "128-37-0", "317-34-0", None]
    asked = [(n, c) for n, c in itertools.product(names, numbers) if n or c]
    by_name, by_cas = {}, {}
    for sid, _section, name, cas, _active in subs:
        by_name.setdefault(name.lower(), set()).add(sid)
        for c in cas:
            by_cas.setdefault(c, set()).add(sid)

    def expected(name, cas):
        n, c = by_name.get((name or "").lower(), set()), by_cas.get(cas, set())
        if name and cas:
            if not n and not c:
                return "unresolved"
            if len(n & c) == 1:
                return "resolved"
            return "ambiguous" if n and c else "review_required"
        ids = n if name else c
        return "resolved" if len(ids) == 1 else "ambiguous" if ids else "unresolved"

    requests = resolve.identity_requests(spark.createDataFrame(asked, "name string, cas_number string"))
    empty = spark.createDataFrame([], "advisory_substance_id string, controlling_substance_id string, comparison_status string")
    got = {(r["name"], r["cas_number"]): r["status"] for r in resolve.resolve(requests, lookup.substance_lookup(df), empty, None).collect()}
    assert got == {(n, c): expected(n, c) for n, c in asked}


def test_facts_are_joined_once_and_not_by_nested_loops(results):
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_summary_counts_every_row(results):
    row = formulation.formulation_summary(results).first()
    assert row["ingredients_submitted"] == len(CASES) == sum(row[f] for f in K.FINDINGS)


def test_supporting_evaluations_follow_the_finding(results):
    rows = {(r["row_number"], r["finding"]) for r in screen.supporting_evaluations(results).collect()}
    above = next(i for i, c in enumerate(CASES) if c[0] == "Warned" and c[3][0] == 1.5)
    assert (above, K.EXCEEDED) in rows
