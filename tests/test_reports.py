"""Reports, evidence, fingerprints and keys on small tables."""

import json
import os

from pyspark.sql import functions as F

from assayer.functions import labels
from assayer.functions import text as X
from assayer.operators import explain, formulation, grid, quality, rules, screen
from assayer.session import CLEANUP, materialize, scratch, settle, shared_folder, tidy
from assayer.sources import extraction, snapshots


def test_numbers_are_written_out(spark):
    values = [1.0, 0.0001, 2e7, 0.5, 1e-9, 12.25, 0.0, -3.0, 123456789.5, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(labels.number(F.col("v"))).collect()]
    assert got == ["1", "0.0001", "20000000", "0.5", "0.000000001", "12.25", "0", "-3", "123456789.5", None]


def test_ascii_tables_need_no_python(spark):
    plain = spark.createDataFrame([(" A  b",), (None,), ("",)], "n string")
    keyed = X.normalize_names(plain, "n", "k")
    assert "Python" not in keyed._jdf.queryExecution().executedPlan().toString()
    assert [r["k"] for r in keyed.collect()] == ["a b", "", ""]
    mixed = spark.createDataFrame([("Straße –x",), ("É",), ("É",), ("A",), (None,)], "n string")
    for kind, fold in (("regulatory", X.normalize_names), ("catalogue", X.catalogue_keys), ("grid", X.grid_keys)):
        want = sorted(r[0] for r in mixed.select(X.text_key(F.col("n"), kind)).collect())
        assert sorted(r["k"] for r in fold(mixed, "n", "k").collect()) == want


def test_stages_of_a_batch_are_removed(spark):
    with scratch(spark):
        inside = materialize(spark.range(3), "inside")
        folder = inside.inputFiles()[0].split("/part-")[0].removeprefix("file://").removeprefix("file:")
        assert os.path.isdir(folder)
    outside = materialize(spark.range(3), "outside")
    assert not os.path.exists(folder) and outside.count() == 3


def test_fingerprints_see_changes_of_equal_length(spark):
    rows = [(1, "ab", None), (2, "", "x"), (2, "", "x")]
    schema = "i int, t string, u string"
    prints = [
        snapshots.row_fingerprint(spark.createDataFrame(r, schema)).first()["fingerprint"]
        for r in (rows, rows[::-1], [(1, "ba", None), *rows[1:]], [(1, "ab", ""), *rows[1:]], rows[:2])
    ]
    assert prints[0] == prints[1] and len(set(prints)) == 4
    assert snapshots.row_fingerprint(spark.createDataFrame([], schema)).first()["row_count"] == 0


def test_manifest_counts_pages_and_keeps_the_rest(spark):
    files = spark.createDataFrame([("a", bytearray(b"xyz"))], "source_document string, content binary")
    definitions = spark.createDataFrame([("a", "who", "rev 2", "en", None)], "source_document string, authority string, document_revision string, language string, note string")
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2)], "source_document string, source_page int")
    row = snapshots.source_manifest(files, definitions, pages).first()
    assert (row["content_bytes"], row["page_count"], row["authority"], row["document_revision"], row["metadata"]) == (3, 2, "who", "rev 2", {"language": "en"})
    assert snapshots.source_manifest(files, definitions).first()["page_count"] is None


def test_report_states(spark):
    prints = lambda **items: spark.createDataFrame(list(items.items()), "item string, fingerprint string")
    none = spark.createDataFrame([], "code string, key string, detail string")
    few = spark.createDataFrame([("normalized",)], "normalization_status string")
    references = spark.createDataFrame([("aligned",)], "comparison_status string")
    now = prints(a="1", b="2")

    def report(errors, previous):
        rows = quality.validation_report(errors, few, references, {"rules": few}, none, now, previous).collect()
        return {r["metric"]: r["value"] for r in rows}

    good = report(none.unionByName(quality.baseline_issues(now, prints(a="1", b="2"), "v", "v")), prints(b="2", a="1"))
    assert good == {
        "validation_status": "passed", "rules:normalized": "1", "cross_references:aligned": "1", "count:rules": "1",
        "accepted_baseline_status": "matched", "reproducibility_status": "matched_previous_run",
    }
    bad = report(quality.baseline_issues(now, prints(a="1", b="3", c="4"), "v", "v"), None)
    assert bad["accepted_baseline_status"] == "mismatched" and bad["errors:accepted_output_baseline_mismatch"] == "2"
    assert bad["validation_status"] == "failed" and bad["reproducibility_status"] == "baseline_created_or_outputs_changed"
    assert report(quality.baseline_issues(now, None, "v"), now)["accepted_baseline_status"] == "missing"
    assert report(quality.baseline_issues(now, now, "v", "w"), now)["accepted_baseline_status"] == "mismatched"


def test_sources_on_one_side_are_reported(spark):
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source_document string, sha256 string")
    expected = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "source_document string, sha256 string")
    got = {(r["code"], r["key"]) for r in quality.source_metadata_check(manifest, expected).collect()}
    assert {("source_hash_changed", "b"), ("source_without_expected_hash", "c"), ("source_missing", "d")} < got
    assert sum(code == "missing_snapshot_metadata" for code, _ in got) == 3


def test_evidence_of_records_with_and_without_fragments(spark):
    own = spark.createDataFrame([("r1", "x1", "Third Schedule Part I"), ("r2", "x2", "Annex II Part 1")], "rule_id string, raw_record_id string, regulatory_section string")
    raw = spark.createDataFrame(
        [("x1", "text", [(4, "row one"), (5, "row two")]), ("x2", "other", [])],
        "raw_record_id string, source_text string, fragments array<struct<source_page:int,original_row_text:string>>",
    )
    got = {(r["rule_id"], r["position"]): json.loads(r["fragment"]) for r in screen.evidence_fragments(own, raw).collect()}
    assert got == {
        ("r1", 0): {"raw_record_id": "x1", "source_page": 4, "original_row_text": "row one"},
        ("r1", 1): {"raw_record_id": "x1", "source_page": 5, "original_row_text": "row two"},
        ("r2", 0): {"raw_record_id": "x2", "source_text": "other"},
    }
    provisions = spark.createDataFrame([("sg-regulation-6-7", "doc", "all")], "provision_id string, source_document string, source_text string")
    sources = spark.createDataFrame([("doc", "rev", "hash", "url", "d1", "d2")], "source_document string, document_revision string, sha256 string, source_url string, effective_date string, retrieval_date string")
    stamped = rules.provision_snapshot(provisions, sources)
    cited = [(r["rule_id"], r["position"], r["source_version"], r["corresponds_to"]) for r in screen.evidence_provisions(own, stamped).collect()]
    assert cited == [("r1", 1, "rev", None)]


def test_metadata_is_held_by_a_cited_cell(spark):
    metadata = spark.createDataFrame([(1, "name", " My  Cream"), (1, "id", "F1"), (1, "context", None), (2, "name", "Gone"), (2, "id", None)], "file_id int, field string, value string")
    cited = spark.createDataFrame(
        [(1, "name", 0, 3, 1, "other"), (1, "name", 1, 4, 0, "my cream"), (2, "name", 0, 1, 1, "here"), (2, "id", 0, 1, 1, "here")],
        "file_id int, field string, position int, source_row int, source_column_index int, source_value string",
    )
    columns = spark.createDataFrame([(1, 1, "Amount")], "file_id int, source_column_index int, label string")
    rows, errors = grid.ground_metadata(metadata, cited, columns)
    assert [tuple(r) for r in rows.collect()] == [(1, "name", " My  Cream", "other", 3, 1, "Amount")]
    assert {tuple(r) for r in errors.collect()} == {(1, "id", "metadata_without_source"), (2, "name", "metadata_not_in_cited_cells"), (2, "id", "null_metadata_cites_cells")}


def test_footnotes_of_a_record_come_from_all_its_rows(spark):
    rows = [("d", "s", 1, 0, ["A1", "one"]), ("d", "s", 1, 1, ["", "two"]), ("d", "s", 2, 0, ["A2", "three"])]
    stitched = extraction.stitch_continuation_rows(spark.createDataFrame(rows, "source_document string, section string, source_page int, row_index int, cells array<string>"))
    notes = spark.createDataFrame([("d", "s", 1, 0, "12"), ("d", "s", 1, 1, "2"), ("d", "s", 1, 1, "12")], "source_document string, section string, source_page int, row_index int, footnote_number string")
    got = {r["text"]: r["footnote_references"] for r in extraction.finalize_raw_record(stitched, ["reference", "text"], notes).collect()}
    assert got == {"one\ntwo": ["2", "12"], "three": []}
    assert extraction.finalize_raw_record(stitched, ["reference", "text"]).first()["footnote_references"] == []


def test_tables_of_a_page_and_required_names(spark):
    tables = spark.createDataFrame([("d", 1, 1, 3), ("d", 1, 0, 5), ("d", 2, None, None)], "source_document string, source_page int, table_index int, column_count int")
    got = {r["source_page"]: (r["table_count"], r["column_counts"]) for r in extraction.table_diagnostics(tables, 3).collect()}
    assert got == {1: (1, [5, 3]), 2: (0, [])}
    catalogue = spark.createDataFrame([("e1", "GLYCERIN")], "ingredient_id string, canonical_name string")
    sources = spark.createDataFrame([("e1", 7, 2), ("e1", 9, 3)], "ingredient_id string, entry_number int, source_page int")
    names = spark.createDataFrame([("GLYCERIN",), ("NIACINAMIDE",)], "canonical_name string")
    found = sorted(map(tuple, quality.required_names(names, catalogue, sources).collect()), key=repr)
    assert found == [("GLYCERIN", True, 7, 2), ("GLYCERIN", True, 9, 3), ("NIACINAMIDE", False, None, None)]


def test_groups_of_repeated_rows_are_counted(spark):
    rows = [("f", 1, "Aqua"), ("f", 2, " AQUA "), ("f", 3, "Aqua"), ("f", 4, "Salt"), ("f", 5, "salt"), ("g", 1, "Aqua")]
    df = spark.createDataFrame(rows, "formulation_id string, row_number int, name string").selectExpr(
        "*", "CAST(NULL AS STRING) AS cas_number", "CAST(NULL AS STRING) AS product_context",
        "CAST(NULL AS STRUCT<value: DOUBLE, unit: STRING, basis: STRING, preparation_stage: STRING>) AS concentration",
    )
    assert [tuple(r) for r in formulation.duplicate_groups(df).collect()] == [("f", 2)]
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_summary_takes_the_listed_duplicates(spark):
    """Groups are counted by their first rows, as the SQL does: one that comes twice counts twice, one without a number not."""
    rows = [("f", 1, "Aqua"), ("f", 1, " AQUA "), ("f", 4, "Salt"), ("f", 5, "salt"), ("g", None, "Aqua"), ("g", None, "aqua"), ("h", 1, "Aqua")]
    df = spark.createDataFrame(rows, "formulation_id string, row_number int, name string").selectExpr(
        "*", "CAST(NULL AS STRING) AS cas_number", "CAST(NULL AS STRING) AS product_context",
        "CAST(NULL AS STRUCT<value: DOUBLE, unit: STRING, basis: STRING, preparation_stage: STRING>) AS concentration",
    )
    results = df.selectExpr("formulation_id", "'identity_unresolved' AS primary_finding", "true AS review_required")
    duplicates = formulation.duplicate_rows(df)
    assert duplicates.columns == ["formulation_id", "first_row", "row_number"]
    got = formulation.formulation_summary(results, duplicates).collect()
    assert {r["formulation_id"]: (r["ingredients_submitted"], r["duplicate_row_groups"]) for r in got} == {"f": (4, 3), "g": (2, 0), "h": (1, 0)}


def test_settled_stages_leave_no_shuffle_files(spark):
    import time

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        names = disk.getAllFiles()
        return sum(names.apply(i).getName().startswith("shuffle_") for i in range(names.size()))

    spark.conf.set(CLEANUP, "false")
    before, end = shuffled(), time.time() + 20
    settle(spark.range(1000).repartition(4, "id"), "settled")
    while shuffled() > before and time.time() < end:  # files are removed in the background
        time.sleep(0.2)
    assert shuffled() <= before and spark.conf.get(CLEANUP) == "false"
    with tidy(spark):
        assert spark.conf.get(CLEANUP) == "true"
    spark.conf.unset(CLEANUP)


def test_coverage_reads_verdicts_that_are_written_once(spark):
    from assayer.plans import registry

    covered = registry.queries()["explanation_coverage"](spark, "/root/testdata/sf0.001")
    assert {f.split("/")[-2].rsplit("-", 1)[0] for f in covered.inputFiles()} == {"verdicts", "request-keys"}


def test_requests_are_keyed_once(spark):
    """Ranks and answer come from the written keys, not from two evaluations of the payloads."""
    rows = [(1, n, f"p{n % 2}") for n in (5, 3, 9, 7, 7)] + [(2, 1, "p0"), (None, 1, "p0"), (3, None, "p1")]
    payloads = spark.createDataFrame(rows, "formulation_id int, row_number int, payload string")
    requests = explain.explanation_requests(payloads, 3)
    assert {f.split("/")[-2].rsplit("-", 1)[0] for f in requests.inputFiles()} == {"request-keys"}
    assert sorted((r["formulation_id"], r["row_number"] or 0, str(r["truncated"])) for r in requests.collect()) == [
        (1, 3, "False"), (1, 5, "False"), (1, 7, "False"), (1, 7, "False"), (1, 9, "True"), (2, 1, "False"), (3, 0, "None"),
    ]
