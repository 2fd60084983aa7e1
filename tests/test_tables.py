"""Ordered, ranked and stateful jobs against plain Python on small skewed tables."""

import json
import random

from pyspark.sql import functions as F

from assayer.operators import grid as G
from assayer.operators import linkage as L
from assayer.operators import quality as V
from assayer.operators import rules as R
from assayer.operators import search as Q
from assayer.operators import sessions as T
from assayer.session import shared_folder
from assayer.sources import extraction as E
from assayer.sources import snapshots as S
from assayer.sources import uploads as U
from assayer.streaming import jobs as W


def test_continuation_rows_with_one_document_holding_most_rows(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for doc, pages in (("big", 2600), ("small", 3), ("none", 2)):
        current = None
        for page in range(pages):
            for i in range(rng.choice([0, 1, 3])):
                opens = doc != "none" and rng.random() < 0.02
                rows.append((doc, "s", page, i, [f"A{page}" if opens else "", "text"]))
                current = f"A{page}" if opens else current
                expected[(doc, page, i)] = current
    df = spark.createDataFrame(rows, "source_document string, section string, source_page bigint, row_index int, cells array<string>")
    got = {(r["source_document"], r["source_page"], r["row_index"]): r["reference_number"] for r in E.stitch_continuation_rows(df).collect()}
    assert got == expected


def test_header_and_blank_rows_are_dropped(spark):
    rows = [("d", "s", 1, 0, ["Ref No", "x"]), ("d", "s", 1, 1, [" ", None]), ("d", "s", 1, 2, ["8a\nx", "Name"]), ("d", "s", 2, 0, ["", "more"])]
    df = spark.createDataFrame(rows, "source_document string, section string, source_page bigint, row_index int, cells array<string>")
    record = E.finalize_raw_record(E.stitch_continuation_rows(df), ["reference_raw", "name"]).first()
    assert (record["raw_record_id"], record["name"], record["source_text"]) == ("raw-d-s-8a", "Name\nmore", "8a\nx | Name\n | more")
    assert record["extraction_flags"] == ["entry_spans_multiple_pages"] and record["source_pages"] == [1, 2]


def test_words_between_two_markers_belong_to_both(spark):
    words = [(1, 50.0, 200.0, "7"), (1, 130.0, 200.0, "ALPHA"), (1, 180.0, 201.5, "BETA"), (1, 130.0, 212.0, "GAMMA"),
             (1, 130.0, 298.5, "EDGE"), (1, 50.0, 300.0, "8"), (1, 130.0, 300.0, "DELTA"), (1, 130.0, 799.5, "FOOT")]
    df = spark.createDataFrame(words, "page int, x0 double, top double, text string")
    got = {r["entry_number"]: (r["canonical_name"], r["source_lines"]) for r in E.entry_lines(E.words_to_glossary_rows(df)).collect()}
    assert got == {7: ("ALPHA BETA GAMMA EDGE", ["ALPHA BETA", "GAMMA", "EDGE"]), 8: ("EDGE DELTA", ["EDGE DELTA"])}


def test_a_record_of_many_rows_keeps_its_text_whole(spark):
    rows = [("d", "s", 1, i, ["7" if i == 0 else "", f"t{i}"]) for i in range(900)] + [("d", "s", 2, 0, ["8", "x"])]
    df = spark.createDataFrame(rows, "source_document string, section string, source_page bigint, row_index int, cells array<string>")
    got = {r["reference_number"]: (r["fragments"], r["source_text"]) for r in E.finalize_raw_record(E.stitch_continuation_rows(df), ["r", "t"]).collect()}
    assert got == {"7": (900, "\n".join(["7 | t0", *(f" | t{i}" for i in range(1, 900))])), "8": (1, "8 | x")}


def test_top_k_is_limited_before_the_shuffle(spark):
    catalogue = spark.createDataFrame([("i", "AQUA", "aqua")], "ingredient_id string, canonical_name string, search_name string")
    df = Q.ranked_catalogue_search(spark.createDataFrame([("aq",)], "query string"), catalogue, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit [query_key" in plan and "Exchange hashpartitioning(query_key" in plan


def test_small_markers_are_footnotes(spark):
    text = "Acid(12)x(3)"
    chars = [(1, i, ch, 10.0 + i, 100.0, 4.0 if 4 <= i <= 7 else 10.0) for i, ch in enumerate(text)]
    boxes = [(1, 1, 0.0, 500.0, 90.0, 110.0), (1, 2, 0.0, 500.0, 111.0, 130.0)]
    got = E.superscript_footnote_refs(
        spark.createDataFrame(chars, "page int, seq int, text string, x double, y double, size double"),
        spark.createDataFrame(boxes, "page int, row_id int, x0 double, x1 double, top double, bottom double"),
    ).collect()
    assert [(r["row_id"], r["footnote_number"]) for r in got] == [(1, "12")]


def test_search_equals_a_full_scan(spark):
    rng = random.Random(5)
    names = [(f"id-{i:03d}", " ".join(rng.choice(["aqua", "acid", "oil", "aquarius", "oleic"]) for _ in range(rng.randint(1, 3)))) for i in range(150)]
    unique = {n: i for i, n in reversed(names)}
    catalogue = [(i, n.upper(), n) for n, i in unique.items()]
    asked = ["aqua", "AQ", "ci", "acid oil", "x", "oleic acid", "q", "zz", "l"]
    expected = {}
    for query in {a.lower() for a in asked if len(a) >= 2}:
        hits = sorted((0 if n == query else 1 if n.startswith(query) else 2, n, i) for i, _, n in catalogue if query in n)[:5]
        expected.update({(query, p + 1): h for p, h in enumerate(hits)})
    df = Q.ranked_catalogue_search(
        spark.createDataFrame([(a,) for a in asked], "query string"),
        spark.createDataFrame(catalogue, "ingredient_id string, canonical_name string, search_name string"), 5,
    )
    got = {(r["query_key"], r["position"]): (r["rank"], r["search_name"], r["ingredient_id"]) for r in df.collect()}
    assert got == expected
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_revisions_replayed_one_by_one(spark):
    rng = random.Random(11)
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 5), i, rng.randint(0, 400), rng.randint(0, 6)) for i in range(600)]
    expected, current = set(), {}
    for key, update, ts, revision in sorted(rows, key=lambda r: (r[2], r[1])):
        if revision == current.get(key, 0):
            expected.add(update)
            current[key] = revision + 1
    df = spark.createDataFrame(rows, "session_key int, update_id int, ts int, revision int")
    got = {r["update_id"] for r in T.revision_conflicts(df).collect() if r["accepted"]}
    assert got == expected


def test_sessions_end_only_after_more_than_the_gap(spark):
    base = 1_700_000_000
    times = [0, 3600, 7200, 10801, 10802, 20000]
    df = spark.createDataFrame([("k", base + t) for t in times], "session_key string, s bigint").select(
        "session_key", F.timestamp_seconds("s").alias("ts")
    )
    got = sorted((r["session_number"], r["events"]) for r in T.session_expiry(df).collect())
    assert got == [(1, 3), (2, 2), (3, 1)]


def test_sequence_gaps_across_partitions(spark):
    present = set(range(3, 50)) - {7, 8, 20, 21, 22, 41}
    df = spark.createDataFrame([(n,) for n in present], "n int")
    got = sorted(r["detail"] for r in V.sequence_gaps(df.repartition(5), "n").collect())
    assert got == sorted(["1-2", "7-8", "20-22", "41-41"])


def test_catalogue_keeps_the_lowest_entry_of_a_name(spark):
    rows = [(14589, "SAME NAME", 410, "r2"), (14588, "SAME NAME", 409, "r1"), (5, "OTHER", 3, "r3"), (6, "Other", 3, "r4")]
    df = spark.createDataFrame(rows, "entry_number int, canonical_name string, source_page int, raw_record_id string")
    got = {r["search_name"]: (r["ingredient_id"], r["source_rows"], r["first_page"]) for r in R.build_catalogue(df).collect()}
    assert got == {"same name": ("entry-14588", 2, 409), "other": ("entry-00005", 2, 3)}
    kinds = {r["search_name"]: r["kind"] for r in R.catalogue_key_collisions(df).collect()}
    assert kinds == {"same name": "duplicate_rows", "other": "different_names"}


FILES = {
    "clean.csv": b"Ingredient,Concentration\nNIACINAMIDE,5%\nGLYCERIN,4%\n",
    "messy.txt": "﻿RM Name;INCI;Dosage\nB3;Niacinamide;5\nBase;\"Glycerin; pure\";4%\n".encode(),
    "wide.tsv": "a\tb\n1\t2\n".encode("utf-16"),
    "rows.json": b'{"rows": [["a", null, true], [1, 2.5], [1.0, [1, 2], 1e5, false, 1e-7]]}',
    "bad.json": b'{"rows": [1]}',
    "empty.csv": b"",
    "blank.csv": b" , \n , \n",
    "latin.csv": b"caf\xe9,1\n",
    "big.csv": b"x" * (2 * 1024 * 1024 + 1),
    "long.csv": b"a,b\n" * 63000,
    "notes.docx": b"x",
    "spaces.csv": "\t \xa0\u2003\n".encode(),
    "open.csv": b'a,b\n"c,d\n',
    "after.csv": b'a,b\n"c"d,e\n',
    "lines.csv": b'a;b\r\n"x; ""y""\nz";2\r\n\r\n3;4 "q"',
    "odd.tsv": b"\xff\xfea",
    "rows.txt": b"a,b\n" * 501,
    "columns.txt": b"a," * 50 + b"z\n",
    "cell.txt": b"a," + b"z" * 8193,
    "wide.json": '[["a"]]'.encode("utf-16"),
    "shape.json": b"[" + b",".join([b"[1]"] * 501) + b"]",
    "text.json": b'{"rows": "x"}',
}


def test_upload_reading_and_limits(spark):
    df = spark.createDataFrame([(n, n, bytearray(c)) for n, c in FILES.items()], "file_id string, filename string, content binary")
    grid = {}
    for r in U.upload_cells(df.filter("file_id in ('clean.csv', 'messy.txt', 'wide.tsv', 'rows.json', 'lines.csv')")).collect():
        grid.setdefault(r["file_id"], {})[(r["source_row"], r["source_column_index"])] = r["source_value"]
    assert grid["clean.csv"][(2, 1)] == "5%" and grid["messy.txt"][(1, 0)] == "RM Name"
    assert grid["messy.txt"][(3, 1)] == "Glycerin; pure" and grid["wide.tsv"][(2, 1)] == "2"
    assert grid["rows.json"] == {(1, 0): "a", (1, 1): "", (1, 2): "TRUE", (2, 0): "1", (2, 1): "2.5", (3, 0): "1.0", (3, 1): "[1, 2]",
                                 (3, 2): "100000.0", (3, 3): "FALSE", (3, 4): "1e-07"}
    assert grid["lines.csv"] == {(1, 0): "a", (1, 1): "b", (2, 0): 'x; "y"\nz', (2, 1): "2", (4, 0): "3", (4, 1): '4 "q"'}
    codes = {r["file_id"]: r["code"] for r in U.grid_bounds_check(df).collect()}
    assert codes == {
        "bad.json": "agent_csv_malformed", "empty.csv": "agent_csv_empty", "blank.csv": "agent_csv_empty",
        "latin.csv": "agent_csv_encoding_unsupported", "big.csv": "agent_csv_too_large", "long.csv": "agent_csv_too_large",
        "notes.docx": "agent_csv_type_unsupported", "spaces.csv": "agent_csv_empty", "open.csv": "agent_csv_malformed",
        "after.csv": "agent_csv_malformed", "odd.tsv": "agent_csv_encoding_unsupported", "rows.txt": "agent_csv_too_many_rows",
        "columns.txt": "agent_csv_too_many_columns", "cell.txt": "agent_csv_cell_too_large", "shape.json": "agent_csv_shape_invalid",
        "text.json": "agent_csv_malformed", "wide.json": "agent_csv_malformed",
    }
    assert U.upload_cells(df.filter("file_id = 'clean.csv'"), U.Limits(file_bytes=10)).count() == 0


def test_messy_file_leaves_the_known_open_points(spark):
    lines = [("Niacinamide", "5"), ("Glycerin", "4%"), ("Tosyl chl Na", ".21"), ("Aqua", "balance"), ("Parfum", "QS")]
    refs = [("f", f"r{i}", field, 0, i + 2, col, pair[col]) for i, pair in enumerate(lines) for col, field in enumerate(("name", "amount"))]
    references = spark.createDataFrame(refs, "file_id string, row_id string, field string, position int, source_row int, source_column_index int, source_value string")
    mappings = spark.createDataFrame([("f", 0, "ingredient_name")], "file_id string, source_column_index int, mapped_field string")
    names = {"Tosyl chl Na": "Tosylchloramide sodium"}
    proposals = spark.createDataFrame(
        [("f", f"r{i}", names.get(n, n), False, None, None, None, None) for i, (n, _) in enumerate(lines)],
        "file_id string, row_id string, interpreted_name string, identity_uncertain boolean, proposed_value double, proposed_cas string, proposed_basis string, proposed_stage string",
    )
    catalogue = spark.createDataFrame([("e1", "NIACINAMIDE", "niacinamide"), ("e2", "GLYCERIN", "glycerin")], "ingredient_id string, canonical_name string, search_name string")
    named = G.map_ingredient_names(references, mappings, proposals, catalogue)
    rows, errors = G.ground_amounts(proposals.drop("interpreted_name", "identity_uncertain"), references)
    got = {}
    for r in G.row_uncertainties(named, rows).collect():
        got.setdefault(r["uncertainty_code"], set()).add(r["row_id"])
    assert errors.isEmpty()
    assert got == {
        "ingredient_identity": {"r2"}, "missing_concentration_unit": {"r0", "r2"},
        "concentration_unavailable": {"r3", "r4"}, "preparation_stage": {"r0", "r1", "r2"},
    }


def test_linkage_rejects(spark):
    review = (True, "2026-09-20", "Reviewer", "basis")
    rows = [("ok", "Name", "verified_not_represented", [], review, "v1"), ("no-target", "Name", "linked", [], review, "v1"),
            ("target", "Name", "unresolved", ["r"], review, "v1"), ("unreviewed", "Name", "unresolved", [], (False, "2026-09-20", "R", "b"), "v1"),
            ("case", "NAME", "unresolved", [], review, "v1"), ("twice", "Name", "unresolved", [], review, "v1"), ("twice", "Name", "unresolved", [], review, "v1"),
            ("stale", "Name", "unresolved", [], review, "v0"), ("ghost", "Name", "unresolved", [], review, "v1")]
    schema = ("catalogue_ingredient_id string, catalogue_canonical_name string, status string, singapore_raw_record_ids array<string>, "
              "review struct<reviewed:boolean,reviewed_at:string,reviewer:string,review_basis:string>, identity_dataset_hash string")
    known = [(i, "Name") for i in ("ok", "no-target", "target", "unreviewed", "case", "twice", "stale")]
    got = {(r["catalogue_ingredient_id"], r["code"]) for r in L.validate_linkage_decisions(
        spark.createDataFrame(rows, schema), spark.createDataFrame(known, "ingredient_id string, canonical_name string"), {"identity_dataset_hash": "v1"}).collect()}
    assert got == {("no-target", "linked_without_target"), ("target", "target_without_link"), ("unreviewed", "not_reviewed"), ("case", "name_mismatch"),
                   ("twice", "duplicate_identity"), ("stale", "stale_binding"), ("ghost", "unknown_identity")}


def test_raw_documents_are_read_and_snapshots_written(spark, tmp_path):
    document = {"dataset_version": "v1", "source_document": "doc", "section": "Annex II Part 1",
                "records": [{"raw_record_id": "r1", "reference_number": "1", "source_pages": [2, 3]}, {"raw_record_id": "r2", "reference_number": "2"}]}
    (tmp_path / "raw.json").write_text(json.dumps(document, indent=1))
    records = S.load_raw_records(spark, str(tmp_path / "raw.json"))
    assert [(r["section"], r["raw_record_id"], r["source_pages"]) for r in records.orderBy("raw_record_id").collect()] == [
        ("Annex II Part 1", "r1", [2, 3]), ("Annex II Part 1", "r2", None)]
    S.snapshot_sink(records.drop("dataset_version"), str(tmp_path / "out"), "v2", ["raw_record_id"])
    assert spark.read.parquet(str(tmp_path / "out")).filter("dataset_version = 'v2'").count() == 2
    files = S.read_source_files(spark, str(tmp_path / "raw.json"))
    assert files.first()["source_document"] == "raw"


def test_a_changed_table_has_another_fingerprint(spark):
    df = spark.range(100).withColumn("t", F.col("id").cast("string"))
    shuffled = df.orderBy(F.desc("id"))
    other = df.withColumn("t", F.when(F.col("id") == 7, "x").otherwise(F.col("t")))
    prints = [S.row_fingerprint(x).first()["fingerprint"] for x in (df, shuffled, other)]
    assert prints[0] == prints[1] != prints[2]
