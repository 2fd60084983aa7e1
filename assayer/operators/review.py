"""Review queue, review cases and the stratified review pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import constants as K

SEMANTIC_FIELDS = ("product_context", "concentration", "concentration_text", "other_conditions", "required_warning")


def review_queue(rules: DataFrame, cross_references: DataFrame) -> DataFrame:
    """Rules that are not normalised and flagged cross-references, in one schema."""
    rule_items = rules.filter("normalization_status <> 'normalized'").select(
        F.lit("normalized_rule").alias("item_type"), F.col("rule_id").alias("item_id"), "reference_number",
        "regulatory_section", "raw_record_id", "review_reasons",
    )
    reference_items = cross_references.filter("professional_review_required").select(
        F.lit("cross_reference").alias("item_type"), F.col("cross_reference_id").alias("item_id"), "reference_number",
        "regulatory_mapping", "comparison_status", "review_reasons",
    )
    return rule_items.unionByName(reference_items, allowMissingColumns=True)


def queue_summary(queue: DataFrame) -> DataFrame:
    return queue.groupBy("item_type").agg(F.count("*").alias("items"))


def case_keys(rules: DataFrame, links: DataFrame) -> DataFrame:
    """Each rule's review case: its only cross-reference, else its parent, else its place."""
    own = links.groupBy("rule_id").agg(
        F.count("*").alias("_n"), F.min("cross_reference_id").alias("_xref")
    ).filter("_n = 1")
    place = F.concat_ws(":", "source_document", "regulatory_section", "reference_number")
    return rules.join(own.select("rule_id", "_xref"), "rule_id", "left").withColumn(
        "case_key", F.coalesce("_xref", "parent_rule_id", place)
    ).drop("_xref")


def _natural(reference: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(F.lower(reference), "^a", "")
    digits = F.regexp_replace(bare, "[^0-9]", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(10**9).cast("bigint")), bare


def review_candidates(rules: DataFrame, cross_references: DataFrame, links: DataFrame) -> DataFrame:
    """(category, priority, case_key, rule_id, order key) of everything a category may pick."""
    keyed = case_keys(rules, links)
    number, bare = _natural(F.col("reference_number"))
    last = ~F.col("regulatory_section").isin(*K.CONTROLLING_SECTIONS)
    order = F.struct(last.alias("last"), number.alias("number"), bare.alias("text"), F.col("rule_id").alias("tie"))
    by_reason = F.array_compact(
        F.array(
            *[
                F.when(
                    F.array_contains("review_reasons", reason),
                    F.struct(F.lit(K.REVIEW_CATEGORIES.index(c) + 1).alias("priority"), F.lit(c).alias("category")),
                )
                for c, reason in K.REVIEW_REASONS.items()
            ]
        )
    )
    reasons = keyed.select("case_key", "rule_id", order.alias("at"), F.explode(by_reason).alias("c")).select(
        "c.priority", "c.category", "case_key", "rule_id", "at"
    )
    # cross-reference categories are represented by one rule each
    status, fields = F.col("comparison_status"), F.col("changed_fields")
    flagged = cross_references.select(
        "cross_reference_id",
        F.col("reference_number").alias("_reference"),
        F.when(status == "acd_only", "active_acd_only")
        .when((status == "changed") & F.arrays_overlap(fields, F.array(*[F.lit(f) for f in SEMANTIC_FIELDS])), "materially_changed_cross_reference")
        .alias("category"),
    ).filter("category is not null")
    members = links.join(flagged, "cross_reference_id").filter(
        ((F.col("category") == "active_acd_only") & (F.col("side") == "acd") & F.col("active"))
        | ((F.col("category") == "materially_changed_cross_reference") & (F.col("side") == "singapore"))
    )
    represented = members.groupBy("cross_reference_id", "category", "_reference").agg(F.min("rule_id").alias("rule_id"))
    text_order = F.struct(
        F.lit(False).alias("last"), F.lit(0).cast("bigint").alias("number"), F.col("_reference").alias("text"), F.col("rule_id").alias("tie")
    )
    references = represented.join(keyed.select("rule_id", "case_key"), "rule_id").select(
        F.when(F.col("category") == "active_acd_only", 4).otherwise(5).alias("priority"), "category", "case_key", "rule_id", text_order.alias("at")
    )
    return reasons.unionByName(references)


def stratified_review_sample(candidates: DataFrame, per_category: int = 5) -> DataFrame:
    """``per_category`` cases per category, in priority order, no case twice.

    Earlier categories use at most (categories - 1) x per_category keys, so that many more than
    needed are enough from each category. They come from a bounded top-n per category; only this
    short list takes part in the sequential step.
    """
    enough = per_category * len(K.REVIEW_CATEGORIES)
    first = candidates.groupBy("priority", "category", "case_key").agg(
        F.min(F.struct("at", "rule_id")).alias("_first")
    )
    ranked = first.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("priority").orderBy("_first"))
    ).filter(F.col("_rank") <= enough)
    short = ranked.select("priority", "category", "case_key", F.col("_first.rule_id").alias("rule_id"), "_rank")
    # the short list (at most 25 rows per category) is folded in order as one small array
    item = "priority:int,category:string,case_key:string,rule_id:string"
    listed = short.agg(
        F.array_sort(F.collect_list(F.struct("priority", "_rank", "category", "case_key", "rule_id"))).alias("_all")
    )
    picked = F.aggregate(
        "_all",
        F.array().cast(f"array<struct<{item}>>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda a: a["case_key"] == x["case_key"])
            | (F.size(F.filter(acc, lambda a: a["priority"] == x["priority"])) >= per_category),
            acc,
        ).otherwise(F.array_append(acc, F.struct(x["priority"].alias("priority"), x["category"].alias("category"), x["case_key"].alias("case_key"), x["rule_id"].alias("rule_id")))),
    )
    return listed.select(F.explode(picked).alias("p")).select("p.*")


def sample_shortfall(sample: DataFrame, per_category: int = 5) -> DataFrame:
    """Categories with fewer cases than asked for; the pack is only valid when this is empty."""
    counts = sample.groupBy("category").agg(F.count("*").alias("cases"))
    wanted = sample.sparkSession.createDataFrame([(c,) for c in K.REVIEW_CATEGORIES], "category string")
    return wanted.join(counts, "category", "left").select(
        "category", F.coalesce("cases", F.lit(0)).alias("cases")
    ).filter(F.col("cases") < per_category)


def review_cases(sample: DataFrame, rules: DataFrame, cross_references: DataFrame, links: DataFrame) -> DataFrame:
    """The sampled cases with merged reasons and their question; sources are in ``case_sources``."""
    own = rules.select("rule_id", "reference_number", "substance_name", "normalization_status", F.col("review_reasons").alias("_own"))
    xref = links.groupBy("rule_id").agg(F.count("*").alias("_n"), F.min("cross_reference_id").alias("cross_reference_id")).filter("_n = 1").drop("_n")
    status = cross_references.select("cross_reference_id", "comparison_status", F.col("review_reasons").alias("_xref_reasons"))
    question = F.create_map(*[F.lit(x) for pair in K.REVIEW_QUESTIONS.items() for x in pair])
    none = F.array().cast("array<string>")
    return (
        sample.join(own, "rule_id")
        .join(xref, "rule_id", "left")
        .join(status, "cross_reference_id", "left")
        .select(
            F.concat(F.lit("review-"), "category", F.lit("-"), "rule_id").alias("case_id"),
            "priority", "category", "reference_number", "substance_name", "normalization_status", "cross_reference_id",
            F.col("comparison_status").alias("cross_reference_status"),
            F.array_distinct(F.concat("_own", F.coalesce("_xref_reasons", none))).alias("review_reasons"),
            F.element_at(question, F.col("category")).alias("reviewer_question"),
            "rule_id",
        )
    )


def case_sources(cases: DataFrame, links: DataFrame, rules: DataFrame) -> DataFrame:
    """(case_id, rank, rule_id, section, reference): controlling rules, then advisory, then the rule itself."""
    side = F.when(F.col("side") == "singapore", 0).otherwise(1)
    linked = cases.join(links.select("cross_reference_id", F.col("rule_id").alias("_linked"), side.alias("rank")), "cross_reference_id").select(
        "case_id", "rank", F.col("_linked").alias("rule_id")
    )
    own = cases.select("case_id", F.lit(2).alias("rank"), "rule_id")
    merged = linked.unionByName(own).groupBy("case_id", "rule_id").agg(F.min("rank").alias("rank"))
    return merged.join(rules.select("rule_id", "regulatory_section", "reference_number"), "rule_id")
