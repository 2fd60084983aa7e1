"""Reviewed links between catalogue identities and controlling rules.

Targets and reasons are long tables: one row per (identity, rule) or (identity, code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import constants as K
from assayer.functions.text import present

BINDINGS = (
    "identity_dataset_version", "identity_dataset_hash", "singapore_regulatory_baseline", "singapore_regulatory_baseline_hash",
)
TARGET_FIELDS = (
    "raw_record_id", "rule_id", "substance_id", "part", "reference", "source_substance_name", "source_document", "source_hash",
)


def rule_targets(rules: DataFrame) -> DataFrame:
    """Controlling rules in the form a link stores them."""
    return rules.filter(F.col("regulatory_section").isin(*K.CONTROLLING_SECTIONS)).select(
        "raw_record_id", "rule_id", "substance_id", F.col("regulatory_section").alias("part"),
        F.col("reference_number").alias("reference"), F.col("substance_name").alias("source_substance_name"),
        "source_document", "source_hash", "active",
    )


def linkage_candidates(requested: DataFrame, catalogue: DataFrame, lookup: DataFrame, rules: DataFrame) -> DataFrame:
    """Active controlling rules of the substances whose name key equals the identity's catalogue key.

    The regulatory index is asked with the catalogue key on purpose. An identity without candidates
    keeps one row. ``requested`` ids must be unique and known; see ``scope_errors``.
    """
    names = lookup.filter("key_type = 'name' and method = 'exact_name' and not advisory").select(
        F.col("key").alias("search_name"), "substance_id"
    )
    targets = rule_targets(rules).filter("active").select("substance_id", "rule_id", "part", "reference", "raw_record_id")
    candidates = names.join(targets, "substance_id").drop("substance_id").distinct()
    joined = (
        requested.select("catalogue_ingredient_id").distinct()
        .join(catalogue.select(F.col("ingredient_id").alias("catalogue_ingredient_id"), "canonical_name", "search_name"), "catalogue_ingredient_id")
        .join(candidates, "search_name", "left")
    )
    reason = F.when(
        F.col("rule_id").isNotNull(), "Exact normalized Singapore candidate identified; professional verification is required."
    ).otherwise("No deterministic Singapore candidate identified.")
    return joined.select(
        "catalogue_ingredient_id", F.col("canonical_name").alias("catalogue_canonical_name"), "rule_id", "part", "reference",
        reason.alias("reason_for_review"), F.lit("unresolved").alias("current_status"),
    )


def scope_errors(requested: DataFrame, catalogue: DataFrame) -> DataFrame:
    counts = requested.groupBy("catalogue_ingredient_id").agg(F.count("*").alias("_n"))
    known = catalogue.select(F.col("ingredient_id").alias("catalogue_ingredient_id"), F.lit(True).alias("_known"))
    code = F.when(F.col("_known").isNull(), "unknown_identity").when(F.col("_n") > 1, "duplicate_identity")
    return counts.join(known, "catalogue_ingredient_id", "left").select("catalogue_ingredient_id", code.alias("code")).filter("code is not null")


def validate_linkage_decisions(decisions: DataFrame, catalogue: DataFrame, bindings: dict[str, str] | None = None) -> DataFrame:
    """(catalogue_ingredient_id, code) of decisions that may not be accepted; all codes are listed."""
    known = catalogue.select(F.col("ingredient_id").alias("catalogue_ingredient_id"), F.col("canonical_name").alias("_name"))
    repeated = decisions.groupBy("catalogue_ingredient_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    df = decisions.join(known, "catalogue_ingredient_id", "left").join(repeated, "catalogue_ingredient_id", "left")
    targets = F.size(F.coalesce("singapore_raw_record_ids", F.array().cast("array<string>")))
    status, review = F.col("status"), F.col("review")
    stamp = F.replace(review["reviewed_at"], F.lit("Z"), F.lit("+00:00"))
    iso = stamp.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$") & F.try_to_timestamp(stamp).isNotNull()
    stale = F.lit(False)
    for field, value in (bindings or {}).items():
        stale = stale | ~F.col(field).eqNullSafe(F.lit(value))
    checks = [
        (stale, "stale_binding"),
        (F.col("_n").isNotNull(), "duplicate_identity"),
        (F.col("_name").isNull(), "unknown_identity"),
        (F.col("_name").isNotNull() & ~F.col("catalogue_canonical_name").eqNullSafe(F.col("_name")), "name_mismatch"),
        (~F.coalesce(status.isin(*K.LINKAGE_STATUSES), F.lit(False)), "unsupported_status"),
        ((status == "linked") & (targets == 0), "linked_without_target"),
        ((status != "linked") & (targets > 0), "target_without_link"),
        (~F.coalesce(review["reviewed"], F.lit(False)), "not_reviewed"),
        (~F.coalesce(iso, F.lit(False)), "invalid_reviewed_at"),
        (~present(review["reviewer"]), "blank_reviewer"),
        (~present(review["review_basis"]), "blank_review_basis"),
    ]
    codes = F.array_compact(F.array(*[F.when(condition, F.lit(code)) for condition, code in checks]))
    return df.select("catalogue_ingredient_id", F.explode(codes).alias("code")).distinct()


def derive_link_targets(decisions: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, errors) of the raw records that decisions name.

    A raw id given twice, unknown, out of scope or with an inactive rule is an error.
    """
    named = decisions.select("catalogue_ingredient_id", F.explode("singapore_raw_record_ids").alias("raw_record_id"))
    counted = named.groupBy("catalogue_ingredient_id", "raw_record_id").agg(F.count("*").alias("_n"))
    targets = rule_targets(rules)
    per_record = targets.groupBy("raw_record_id").agg(F.bool_and("active").alias("_active"))
    judged = counted.join(per_record, "raw_record_id", "left").withColumn(
        "code",
        F.when(F.col("_n") > 1, "duplicate_target")
        .when(F.col("_active").isNull(), "unknown_or_out_of_scope_target")
        .when(~F.col("_active"), "inactive_target"),
    )
    errors = judged.filter("code is not null").select("catalogue_ingredient_id", "raw_record_id", "code")
    good = judged.filter("code is null").select("catalogue_ingredient_id", "raw_record_id")
    return good.join(targets.drop("active"), "raw_record_id"), errors


def accepted_linkages(decisions: DataFrame, rejected: DataFrame, baseline: str) -> DataFrame:
    """Decisions without any reject, with their link id."""
    return decisions.join(rejected.select("catalogue_ingredient_id").distinct(), "catalogue_ingredient_id", "left_anti").withColumn(
        "linkage_id", F.concat(F.lit("eu-sg-link-"), "catalogue_ingredient_id", F.lit(f"-{baseline}"))
    )


def linkage_counts(linkages: DataFrame) -> DataFrame:
    return linkages.agg(
        F.count("*").alias("accepted_records"),
        *[F.count_if(F.col("status") == s).alias(s) for s in K.LINKAGE_STATUSES],
    )


def linkage_integrity(linkages: DataFrame, targets: DataFrame, document: dict[str, str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(code, key) faults of an accepted link table: ids, statuses, bindings, targets, counts."""
    has_target = targets.select("catalogue_ingredient_id").distinct().withColumn("_target", F.lit(True))
    repeated = linkages.groupBy("catalogue_ingredient_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    df = linkages.join(has_target, "catalogue_ingredient_id", "left").join(repeated, "catalogue_ingredient_id", "left")
    uneven = F.lit(False)
    for field, value in (document or {}).items():
        uneven = uneven | ~F.col(field).eqNullSafe(F.lit(value))
    target = F.coalesce("_target", F.lit(False))
    checks = [
        (F.col("catalogue_ingredient_id").isNull() | F.col("_n").isNotNull(), "duplicate_or_missing_id"),
        (~F.coalesce(F.col("status").isin(*K.LINKAGE_STATUSES), F.lit(False)), "unsupported_status"),
        (uneven, "binding_mismatch"),
        (~F.coalesce(F.col("review.reviewed"), F.lit(False)), "not_reviewed"),
        ((F.col("status") == "linked") & ~target, "linked_without_target"),
        ((F.col("status") != "linked") & target, "target_without_link"),
    ]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))
    faults = df.select(F.explode(codes).alias("code"), F.col("catalogue_ingredient_id").alias("key")).distinct()
    if counts is None:
        return faults
    names = ["accepted_records", *K.LINKAGE_STATUSES]

    def long(frame: DataFrame, value: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias(value)) for n in names])
        return frame.select(F.explode(pairs).alias("p")).select("p.*")

    compared = long(linkage_counts(linkages), "_is").join(long(counts, "_want"), "key")
    return faults.unionByName(compared.filter("_is <> _want").select(F.lit("count_mismatch").alias("code"), "key"))


def linkage_staleness(
    linkages: DataFrame, targets: DataFrame, catalogue: DataFrame, rules: DataFrame, bindings: dict[str, str]
) -> tuple[DataFrame, DataFrame]:
    """(assessment, reasons) of accepted links against the active data.

    ``reasons`` has one row per finding. A link with any reason counts as unresolved.
    """
    current = catalogue.select(F.col("ingredient_id").alias("catalogue_ingredient_id"), F.col("canonical_name").alias("_name"))
    labels = {
        "identity_dataset_version": "identity dataset version changed",
        "identity_dataset_hash": "identity dataset hash changed",
        "singapore_regulatory_baseline": "Singapore baseline identifier changed",
        "singapore_regulatory_baseline_hash": "Singapore regulatory baseline hash changed",
    }
    own = F.array_compact(
        F.array(
            F.when(~F.col("catalogue_canonical_name").eqNullSafe(F.col("_name")), "catalogue identity wording changed"),
            *[F.when(~F.col(f).eqNullSafe(F.lit(bindings[f])), labels[f]) for f in labels if f in bindings],
        )
    )
    own_reasons = linkages.join(current, "catalogue_ingredient_id", "left").select("linkage_id", F.explode(own).alias("reason"))
    now = rules.select(
        "rule_id",
        F.struct(
            F.col("raw_record_id"), F.col("rule_id").alias("rule_id"), F.col("substance_id"), F.col("regulatory_section").alias("part"),
            F.col("reference_number").alias("reference"), F.col("substance_name").alias("source_substance_name"),
            F.col("source_document"), F.col("source_hash"),
        ).alias("_now"),
        F.col("active").alias("_active"),
    )
    joined = linkages.select("linkage_id", "catalogue_ingredient_id").join(targets, "catalogue_ingredient_id").join(now, "rule_id", "left")

    def said(text: str) -> Column:
        return F.concat(F.lit("target rule "), F.col("rule_id"), F.lit(text))

    differs = F.lit(False)
    for field in TARGET_FIELDS:
        differs = differs | ~F.col(field).eqNullSafe(F.col(f"_now.{field}"))
    gone = ~F.coalesce("_active", F.lit(False)) | ~F.col("_now.part").isin(*K.CONTROLLING_SECTIONS)
    reason = (
        F.when(F.col("_now").isNull(), said(" is unavailable"))
        .when(differs, said(" no longer matches accepted evidence"))
        .when(gone, said(" is no longer active in the accepted scope"))
    )
    target_reasons = joined.select("linkage_id", reason.alias("reason")).filter("reason is not null")
    reasons = own_reasons.unionByName(target_reasons)
    stale = reasons.groupBy("linkage_id").agg(F.count("*").alias("stale_reasons"))
    assessed = linkages.join(stale, "linkage_id", "left").select(
        "linkage_id", "catalogue_ingredient_id", F.col("status").alias("accepted_status"),
        F.coalesce("stale_reasons", F.lit(0)).alias("stale_reasons"),
        F.when(F.col("stale_reasons") > 0, "unresolved").otherwise(F.col("status")).alias("effective_status"),
        F.when(F.col("stale_reasons") > 0, "linkage_not_valid_for_active_baseline")
        .when(F.col("status") == "unresolved", "catalogue_identity_singapore_linkage_unresolved")
        .alias("reason"),
    )
    return assessed, reasons
