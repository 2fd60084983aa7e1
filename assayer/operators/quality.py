"""Checks over snapshot tables. Every check gives rows (code, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import constants as K
from assayer.functions.text import harvested_identifiers, identifier_checksum, present
from assayer.operators.ordering import neighbours
from assayer.sources.snapshots import content_fingerprint


def issues(df: DataFrame, code: str | Column, key: Column | str, detail: Column | str | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    key = F.col(key) if isinstance(key, str) else key
    detail = F.lit(detail) if detail is None or isinstance(detail, str) else detail
    return df.select(code.alias("code"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_keys(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Values that occur more than once; ``tables`` maps a code to (table, column)."""
    found = []
    for code, (df, column) in tables.items():
        counts = df.groupBy(column).agg(F.count("*").alias("_n")).filter("_n > 1")
        found.append(issues(counts, code, column, F.col("_n")))
    return union_all(found)


def expected_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(item, row_count) against the expected numbers; a missing side counts as zero."""
    both = actual.select("item", F.col("row_count").alias("_is")).join(
        expected.select("item", F.col("row_count").alias("_want")), "item", "full_outer"
    )
    is_, want = F.coalesce("_is", F.lit(0)), F.coalesce("_want", F.lit(0))
    return issues(
        both.filter(is_ != want), "unexpected_count", "item",
        F.concat(F.lit("expected "), want.cast("string"), F.lit(", found "), is_.cast("string")),
    )


def page_table_counts(diagnostics: DataFrame, stitched: DataFrame) -> DataFrame:
    """Pages without exactly one table, rows that no record owns, pages without text.

    diagnostics: source_document, source_page, table_count, text.
    """
    page = F.concat_ws(":", "source_document", "source_page")
    return union_all(
        [
            issues(diagnostics.filter("table_count <> 1"), "column_or_table_count_error", page, F.col("table_count")),
            issues(diagnostics.filter(~present(F.col("text"))), "missing_page_text", page),
            issues(
                stitched.filter("kind = 'unassigned'"), "unassigned_continuation_fragment", page, F.array_join("cells", " | ")
            ),
        ]
    )


def sequence_gaps(rows: DataFrame, column: str) -> DataFrame:
    """Gaps in a numbering that must run 1..n: each hole as a range."""
    numbers = rows.select(F.col(column).cast("bigint").alias("n")).filter("n is not null").distinct()
    before = F.coalesce("_previous", F.lit(0))
    holes = neighbours(numbers, [], "n", "_previous").filter(F.col("n") > before + 1)
    return issues(holes, "sequence_gap", before + 1, F.concat_ws("-", before + 1, F.col("n") - 1))


def missing_provenance(df: DataFrame, key: str, required: list[str], code: str) -> DataFrame:
    """Rows with empty required fields, all of them listed."""

    def empty(name: str) -> Column:
        if df.schema[name].dataType.typeName() == "array":
            return F.col(name).isNull() | (F.size(name) == 0)
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    missing = F.array_compact(F.array(*[F.when(empty(n), F.lit(n)) for n in required]))
    return issues(df.withColumn("_missing", missing).filter(F.size("_missing") > 0), code, key, F.array_join("_missing", ","))


def broken_links(rules: DataFrame, raw: DataFrame) -> DataFrame:
    """Rules without their raw record, or with a text that differs from it."""
    joined = rules.join(
        raw.select("raw_record_id", F.col("source_text").alias("_text"), F.lit(True).alias("_found")), "raw_record_id", "left"
    )
    code = F.when(F.col("_found").isNull(), "broken_raw_link").when(
        ~F.col("source_text").eqNullSafe(F.col("_text")), "source_text_loss"
    )
    return issues(joined.withColumn("_code", code).filter("_code is not null"), F.col("_code"), "rule_id")


def allowed_values(df: DataFrame, key: str, column: str, allowed: tuple[str, ...], code: str) -> DataFrame:
    return issues(df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))), code, key, F.col(column))


def invalid_limits(rules: DataFrame) -> DataFrame:
    limit = F.col("concentration")
    bad = limit.isNotNull() & (
        (limit["value"] < 0)
        | ~F.coalesce(limit["unit"].isin(*K.CONCENTRATION_UNITS), F.lit(False))
        | ((limit["unit"] == "percent") & (limit["value"] > 100))
    )
    return issues(rules.filter(bad), "invalid_parsed_concentration", "rule_id", F.concat_ws(" ", limit["value"].cast("string"), limit["unit"]))


def identifier_recheck(rules: DataFrame, substances: DataFrame, raw: DataFrame) -> DataFrame:
    """Recompute identifiers from the raw text and compare with the stored lists."""
    valid, malformed = harvested_identifiers(F.col("cas_number_raw"))
    joined = substances.join(raw.select("raw_record_id", valid.alias("_valid"), malformed.alias("_malformed")), "raw_record_id")
    wrong = rules.select("rule_id", F.explode("cas_numbers").alias("_cas")).filter(~identifier_checksum(F.col("_cas")))
    return union_all(
        [
            issues(joined.filter(~F.col("cas_numbers").eqNullSafe(F.col("_valid"))), "lost_or_changed_valid_cas_identifier", "raw_record_id", F.array_join("_valid", ",")),
            issues(joined.filter(~F.col("malformed_identifiers").eqNullSafe(F.col("_malformed"))), "lost_or_changed_malformed_cas_identifier", "raw_record_id", F.array_join("_malformed", ",")),
            issues(wrong, "malformed_normalized_cas", "rule_id", F.col("_cas")),
            issues(substances.filter(F.size("malformed_identifiers") > 0), "malformed_source_identifier_preserved", "substance_id", F.array_join("malformed_identifiers", ",")),
        ]
    )


def link_direction(links: DataFrame) -> DataFrame:
    """Linked rules whose id prefix does not fit the mapping and side (links: cross_reference_id, side, rule_id)."""
    expected = F.lit(None).cast("string")
    for mapping, sections in K.SECTION_MAPPINGS.items():
        for side, section in zip(("acd", "singapore"), sections):
            here = F.col("cross_reference_id").startswith(f"xref-{mapping}-") & (F.col("side") == side)
            expected = F.when(here, K.RULE_ID_PREFIXES[section] + "-").otherwise(expected)
    tagged = links.withColumn("_expected", expected)
    bad = F.col("_expected").isNull() | ~F.startswith("rule_id", "_expected")
    return issues(tagged.filter(bad).select("cross_reference_id", "rule_id").distinct(), "incorrect_cross_reference_direction", "cross_reference_id", F.col("rule_id"))


def required_keys_present(required: DataFrame, present_keys: DataFrame, code: str) -> DataFrame:
    """Required keys that the table lacks (both sides: ``key``)."""
    return issues(required.join(present_keys.select("key"), "key", "left_anti"), code, "key")


def required_names(required: DataFrame, catalogue: DataFrame, sources: DataFrame) -> DataFrame:
    """(canonical_name, present, entry_number, source_page): each required name with all entries that hold it.

    catalogue: ingredient_id, canonical_name; sources: as from ``catalogue_sources``. An absent name has one row of nulls.
    """
    found = catalogue.select("canonical_name", "ingredient_id").join(sources.select("ingredient_id", "entry_number", "source_page"), "ingredient_id")
    return required.select("canonical_name").distinct().join(found, "canonical_name", "left").select(
        "canonical_name", F.col("ingredient_id").isNotNull().alias("present"), "entry_number", "source_page"
    )


def forbidden_terms(texts: DataFrame, term: str) -> DataFrame:
    """Files with an obsolete term (texts: file, text)."""
    hits = texts.filter(F.lower("text").contains(term.lower())).groupBy("file").agg(F.count("*").alias("_n"))
    return issues(hits, "obsolete_regulation_terminology", "file", F.col("_n"))


def spot_check_sample(samples: DataFrame, raw: DataFrame) -> DataFrame:
    """Fixed samples (position, section, reference_number, focus) looked up in the raw rows."""
    found = raw.select("section", F.lower("reference_number").alias("_ref"), "raw_record_id").groupBy("section", "_ref").agg(
        F.min("raw_record_id").alias("raw_record_id")
    )
    joined = samples.withColumn("_ref", F.lower("reference_number")).join(found, ["section", "_ref"], "left")
    return joined.select(
        F.format_string("spot-%02d", "position").alias("check_id"), "section", "reference_number", "focus", "raw_record_id",
        F.col("raw_record_id").isNull().alias("missing"),
    )


def spot_check_reconcile(
    expected: DataFrame, results: DataFrame, given: DataFrame | None = None, dataset_version: str = "", baseline_sha256: str | None = None
) -> DataFrame:
    """Result rows against the expected ids; failed or unproven checks; ids given twice; what the results were made for.

    given: the result file's own dataset_version and accepted_baseline_sha256, one row.
    """
    counts = results.groupBy("check_id").agg(
        F.count("*").alias("_n"),
        F.bool_or(
            (F.coalesce("result", F.lit("")) != "PASS") | ~present(F.col("evidence_checked")) | ~present(F.col("notes"))
        ).alias("_bad"),
    )
    both = expected.select("check_id", F.lit(True).alias("_want")).join(counts, "check_id", "full_outer")
    code = (
        F.when(F.col("_n").isNull() | F.col("_want").isNull() | (F.col("_n") > 1), "spot_check_result_set_mismatch")
        .when(F.col("_bad"), "incomplete_or_failed_manual_spot_checks")
    )
    found = issues(both.withColumn("_code", code).filter("_code is not null"), F.col("_code"), "check_id")
    if given is None:
        return found
    version, hash_ = F.col("dataset_version"), F.lower(F.coalesce("accepted_baseline_sha256", F.lit("")))
    return union_all(
        [
            found,
            issues(given.filter(~version.eqNullSafe(dataset_version)), "spot_check_dataset_version_mismatch", F.lit("spot_checks"), version),
            issues(given.filter(hash_ != (baseline_sha256 or "").lower()), "spot_check_baseline_hash_mismatch", F.lit("spot_checks"), F.col("accepted_baseline_sha256")),
        ]
    )


def spot_check_counts(expected: DataFrame, results: DataFrame) -> DataFrame:
    """One row: spot_checks (expected ones) and completed_spot_checks (results that passed)."""
    passed = results.agg(F.count_if(F.col("result") == "PASS").alias("completed_spot_checks"))
    return expected.agg(F.count("*").alias("spot_checks")).select(
        "spot_checks", passed.select("completed_spot_checks").scalar().alias("completed_spot_checks")
    )


def baseline_issues(
    outputs: DataFrame, accepted: DataFrame | None, dataset_version: str, accepted_version: str | None = None
) -> DataFrame:
    """Outputs (item, fingerprint) that differ from the accepted ones; a baseline of another version, or none at all."""
    one = outputs.sparkSession.range(1)
    if accepted is None:
        return issues(one, "missing_accepted_output_baseline", F.lit("baseline"))
    if accepted_version != dataset_version:
        return issues(one, "accepted_baseline_dataset_version_mismatch", F.lit("baseline"), F.lit(accepted_version).cast("string"))
    changed = content_fingerprint(outputs, accepted).filter("status <> 'same'")
    return issues(changed, "accepted_output_baseline_mismatch", "item", F.col("status"))


BASELINE_CODES = {
    "missing_accepted_output_baseline": "missing",
    "accepted_baseline_dataset_version_mismatch": "mismatched",
    "accepted_output_baseline_mismatch": "mismatched",
}


def validation_report(
    errors: DataFrame,
    rules: DataFrame,
    cross_references: DataFrame,
    counted: dict[str, DataFrame] | None = None,
    warnings: DataFrame | None = None,
    outputs: DataFrame | None = None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """(metric, value) rows of a run: status, errors and warnings by code, counts, and how outputs compare.

    errors: all issues, those of ``baseline_issues`` among them, which decide accepted_baseline_status. counted: further
    tables whose rows are counted. outputs, previous: (item, fingerprint) of this run and of the last one; equal ones
    make the run reproducible.
    """

    def metric(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("metric"), value.cast("string").alias("value"))

    def by(df: DataFrame, prefix: str, column: str) -> DataFrame:
        return df.groupBy(column).agg(F.count("*").alias("_n")).select(
            F.concat(F.lit(prefix), F.col(column)).alias("metric"), F.col("_n").cast("string").alias("value")
        )

    baseline = F.create_map(*[F.lit(x) for pair in BASELINE_CODES.items() for x in pair])
    states = errors.agg(F.count("*").alias("_n"), F.max(F.element_at(baseline, F.col("code"))).alias("_baseline"))
    parts = [
        metric(states, "validation_status", F.when(F.col("_n") == 0, "passed").otherwise("failed")),
        by(errors, "errors:", "code"),
        by(rules, "rules:", "normalization_status"),
        by(cross_references, "cross_references:", "comparison_status"),
    ]
    if warnings is not None:
        parts.append(by(warnings, "warnings:", "code"))
    for name, table in (counted or {}).items():
        parts.append(metric(table.agg(F.count("*").alias("_n")), f"count:{name}", F.col("_n")))
    if outputs is not None:
        parts.append(metric(states, "accepted_baseline_status", F.coalesce("_baseline", F.lit("matched"))))
        changed = outputs.sparkSession.range(1).select(F.lit(1).cast("bigint").alias("_n"))
        if previous is not None:
            changed = content_fingerprint(outputs, previous).agg(F.count_if(F.col("status") != "same").alias("_n"))
        same = F.when(F.col("_n") == 0, "matched_previous_run").otherwise("baseline_created_or_outputs_changed")
        parts.append(metric(changed, "reproducibility_status", same))
    return union_all(parts)


METADATA_FIELDS = ("effective_date", "retrieval_date", "source_url", "sha256", "snapshot_generated_at")


def source_metadata_check(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """Hashes against the expected ones, sources on one side only, and required metadata that is empty or absent."""
    both = manifest.join(
        expected.select("source_document", F.col("sha256").alias("_want"), F.lit(True).alias("_expected")), "source_document", "full_outer"
    )
    code = (
        F.when(F.col("sha256").isNull() & F.col("_expected"), "source_missing")
        .when(F.col("_want").isNull(), "source_without_expected_hash")
        .when(F.col("sha256") != F.col("_want"), "source_hash_changed")
    )
    compared = issues(both.withColumn("_code", code).filter("_code is not null"), F.col("_code"), "source_document", F.col("sha256"))
    absent = {c: F.lit(None).cast("string") for c in METADATA_FIELDS if c not in manifest.columns}
    whole = manifest.withColumns(absent) if absent else manifest
    return compared.unionByName(missing_provenance(whole, "source_document", list(METADATA_FIELDS), "missing_snapshot_metadata"))
