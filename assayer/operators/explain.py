"""Deterministic explanations of review rows and the checks of proposed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import constants as K
from assayer.functions.labels import STAGE_LABELS
from assayer.functions.text import absent_apart, text_key
from assayer.operators.lookup import METHODS, substance_lookup
from assayer.session import settle

# Fixed explanation texts: (title, summary, what to check). {service} is the name shown to users.
TEXTS = {
    "identity_conflict": (
        "Name and CAS do not match",
        "The ingredient name and CAS number do not point to the same ingredient.",
        "Confirm the correct ingredient name and CAS number.",
    ),
    "identity": (
        "Ingredient identity needs confirmation",
        "The ingredient name and CAS information do not clearly point to one source-backed ingredient.",
        "Confirm the correct INCI or common name and CAS number.",
    ),
    "stage": (
        "Concentration stage needs confirmation",
        "The submitted concentration is for one stage, but the rule applies at a different stage.",
        "Confirm the concentration at the stage stated in the rule.",
    ),
    "context": (
        "Product information is needed",
        "More product information is needed before this rule can be checked.",
        "Confirm the product type or context stated in the rule.",
    ),
    "unit": (
        "Concentration unit needs confirmation",
        "The submitted concentration and the rule use different units.",
        "Confirm the concentration using the unit stated in the rule.",
    ),
    "basis": (
        "Concentration basis needs confirmation",
        "The submitted concentration and the rule use different concentration bases.",
        "Confirm the concentration using the basis stated in the rule.",
    ),
    "exception": (
        "Rule exception needs confirmation",
        "This rule has an exception that still needs checking.",
        "Check whether the exception shown in the regulatory source applies to this formulation.",
    ),
    "information": (
        "More product information is needed",
        "{service} needs more product information before it can check this rule.",
        "Confirm the missing concentration or product details shown in the rule.",
    ),
    "rule": (
        "This rule needs confirmation",
        "{service} found a rule but could not confirm how it applies to this formulation.",
        "Check the rule details against the submitted formulation.",
    ),
}
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
MAX_TITLE_WORDS = 8


def explanation_kind(review_type: Column, reasons: Column) -> Column:
    """First kind whose words occur in the joined reasons; identity reviews come first."""
    text = F.lower(F.array_join(reasons, " "))

    def has(*words: str) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        return hit

    identity = F.coalesce(review_type == "identity_review", F.lit(False))
    incompatible = has("incompatible")
    return (
        F.when(identity & has("resolve_to_different", "only_one_supplied_identifier", "do_not_establish_a_unique"), "identity_conflict")
        .when(identity, "identity")
        .when(has("preparation_stage", "preparation stage"), "stage")
        .when(has("product context", "product_context"), "context")
        .when(incompatible & has("unit"), "unit")
        .when(incompatible & has("basis"), "basis")
        .when(has("condition", "exception"), "exception")
        .when(has("concentration", "information", "missing"), "information")
        .otherwise("rule")
    )


def short_number(value: Column) -> Column:
    """Six significant digits without trailing zeros, as ``%g`` prints them: with an exponent under 1e-4 and from 1e6."""
    digits = F.format_string("%.5e", value)
    exponent = F.regexp_extract(digits, "e([+-][0-9]+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(digits, "^(-?[0-9.]+)e", 1), r"\.?0+$", "")
    sign = F.when(exponent < 0, "-").otherwise("+")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    # The rounded value, written out with as many places as six digits leave.
    exact = digits.cast("decimal(38,12)")
    plain = F.regexp_replace(F.regexp_replace(exact.cast("string"), "0+$", ""), r"\.$", "")
    return F.when(value == 0, "0").when((exponent < -4) | (exponent > 5), scientific).otherwise(plain)


def _amount(value: Column, unit: Column, stage: Column) -> Column:
    shown = F.concat(
        short_number(value), F.when(unit == "percent", "%").otherwise(F.concat(F.lit(" "), F.coalesce(unit, F.lit(""))))
    )
    labels = F.create_map(*[F.lit(x) for pair in STAGE_LABELS.items() for x in pair])
    return F.concat_ws(" · ", F.btrim(shown), F.element_at(labels, stage))


def source_numbers(substances: DataFrame) -> DataFrame:
    """(key, numbers): registry numbers of the first active substance of exactly that name that has any.

    Controlling substances come before advisory ones, then the smallest id.
    """
    named = substance_lookup(substances).where(F.col("method") == METHODS["name"])
    numbered = substances.where(F.size("cas_numbers") > 0).select("substance_id", F.array_join("cas_numbers", ", ").alias("numbers"))
    return (
        named.join(numbered, "substance_id")
        .groupBy("key")
        .agg(F.min_by("numbers", F.struct("advisory", "substance_id")).alias("numbers"))
    )


def submitted_and_rule_facts(results: DataFrame, substances: DataFrame | None = None) -> DataFrame:
    """Facts an explanation may repeat: what was submitted, and what the first rule states.

    Of an identity review the source's registry numbers of the submitted name, if ``substances`` are given.
    """
    if substances is None:
        results = results.withColumn("numbers", F.lit(None).cast("string"))
    else:
        key = text_key(F.col("name"))
        sources = source_numbers(substances).withColumnRenamed("key", "source_key")
        results = results.withColumn("source_key", absent_apart(key, F.col("formulation_id"), F.col("row_number")))
        results = results.join(sources, "source_key", "left").drop("source_key")
    identity = F.col("review_type") == "identity_review"
    who = F.concat_ws(
        " · ",
        F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("Name: "), "name")),
        F.when(F.coalesce("cas_number", F.lit("")) != "", F.concat(F.lit("CAS: "), "cas_number")),
    )
    submitted = F.when(F.coalesce(identity, F.lit(False)), F.when(who != "", who)).when(
        F.col("has_amount"), _amount(F.col("value"), F.col("unit"), F.col("preparation_stage"))
    )
    # the first evaluation that has a limit or a context
    useful = F.get(
        F.filter("evaluations", lambda e: e["limit_value"].isNotNull() | (F.coalesce(e["product_context"], F.lit("")) != "")), F.lit(0)
    )
    limit = F.concat(
        F.when(useful["comparator"] == "less_than_or_equal", "Maximum ").otherwise("Rule limit "),
        _amount(useful["limit_value"], useful["limit_unit"], useful["limit_stage"]),
    )
    rule = F.when(
        F.coalesce(identity, F.lit(False)),
        F.when(
            (F.coalesce("name", F.lit("")) != "") & F.col("numbers").isNotNull(),
            F.concat(F.lit("Source CAS for "), "name", F.lit(": "), "numbers"),
        ),
    ).otherwise(
        F.when(useful["limit_value"].isNotNull(), limit).when(
            useful["product_context"].isNotNull(), F.concat(F.lit("Rule context: "), useful["product_context"])
        ),
    )
    return results.withColumn("submitted_fact", submitted).withColumn("regulatory_fact", rule).drop("numbers")


def fallback_explanations(results: DataFrame, service: str = "The service") -> DataFrame:
    """One of nine fixed explanations per row that needs review."""
    texts = F.create_map(
        *[
            x
            for kind, (title, summary, check) in TEXTS.items()
            for x in (
                F.lit(kind),
                F.struct(F.lit(title).alias("title"), F.lit(summary.format(service=service)).alias("summary"), F.lit(check).alias("what_to_check")),
            )
        ]
    )
    rows = submitted_and_rule_facts(results.filter("review_required"))
    kind = explanation_kind(F.col("review_type"), F.col("review_reasons"))
    return rows.select(
        "formulation_id", "row_number", kind.alias("kind"), F.element_at(texts, kind).alias("t"), "submitted_fact", "regulatory_fact"
    ).select("formulation_id", "row_number", "kind", "t.*", "submitted_fact", "regulatory_fact")


def ground_explanations(proposed: DataFrame, payloads: DataFrame) -> DataFrame:
    """(item_id, code) of proposed explanations that may not be shown; the first failing check.

    proposed: item_id, title, summary, what_to_check, submitted_fact, regulatory_fact. payloads:
    item_id, payload (text), allowed_submitted_fact, allowed_regulatory_fact.
    """
    repeated = proposed.groupBy("item_id").agg(F.count("*").alias("_n"))
    df = payloads.join(proposed.withColumn("_given", F.lit(True)), "item_id", "full_outer").join(repeated, "item_id", "left")
    combined = F.concat_ws(" ", "title", "summary", "what_to_check", "submitted_fact", "regulatory_fact")
    words = F.size(F.filter(F.split(F.coalesce("title", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    tokens = F.regexp_extract_all(combined, F.lit(NUMBER), F.lit(0))
    grounded = F.regexp_extract_all(F.coalesce("payload", F.lit("")), F.lit(NUMBER), F.lit(0))

    def kept(fact: str) -> Column:
        return F.col(fact).isNull() | F.col(fact).eqNullSafe(F.col(f"allowed_{fact}"))

    code = (
        F.when(F.col("_given").isNull(), "missing_result")
        .when(F.col("payload").isNull(), "unknown_item")
        .when(F.col("_n") > 1, "repeated_result")
        .when(words > MAX_TITLE_WORDS, "title_too_long")
        .when(combined.rlike(K.BANNED_CLAIMS), "prohibited_conclusion")
        .when(combined.rlike(K.BANNED_JARGON), "technical_jargon")
        .when(~kept("submitted_fact"), "submitted_fact_changed")
        .when(~kept("regulatory_fact"), "regulatory_fact_changed")
        .when(F.size(F.array_except(tokens, grounded)) > 0, "unsupported_number")
    )
    return df.select("item_id", code.alias("code")).filter("code is not null").distinct()


def explanation_requests(payloads: DataFrame, k: int = K.MAX_EXPLANATIONS) -> DataFrame:
    """Payload rows with their request key; rows after the first k of a formulation are truncated.

    payloads: formulation_id, row_number, payload. The rank is limited to k+1 before the shuffle, so
    a very large formulation is never sorted as a whole. The keyed rows are written once, as they are read for the ranks and
    for the answer.
    """
    keyed = settle(payloads.select("formulation_id", "row_number", F.sha2("payload", 256).alias("request_key")), "request-keys")
    order = Window.partitionBy("formulation_id").orderBy("row_number")
    cut = (
        keyed.select("formulation_id", "row_number")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= k)
        .groupBy("formulation_id")
        .agg(F.max("row_number").alias("_last"))
    )
    return keyed.join(cut, "formulation_id").select(
        "formulation_id", "row_number", "request_key", (F.col("row_number") > F.col("_last")).alias("truncated")
    )


def explanation_dedupe(requests: DataFrame) -> DataFrame:
    """One request per key, with the number of rows its answer goes back to."""
    return requests.filter("not truncated").groupBy("request_key").agg(F.count("*").alias("fan_out"))


def explanation_coverage(results: DataFrame, explained: DataFrame) -> DataFrame:
    """Counts per formulation: requested, by model, by fallback, truncated, and the overall status.

    explained: formulation_id, row_number, truncated, by_model.
    """
    reviewed = results.select("formulation_id", "row_number", "review_required").join(explained, ["formulation_id", "row_number"], "left")
    model = F.coalesce("by_model", F.lit(False)) & ~F.coalesce("truncated", F.lit(False))
    counts = reviewed.groupBy("formulation_id").agg(
        F.count_if("review_required").alias("requested_count"),
        F.count_if(F.col("review_required") & model).alias("model_count"),
        F.count_if(F.col("review_required") & ~model).alias("fallback_count"),
        F.count_if(F.col("review_required") & F.coalesce("truncated", F.lit(False))).alias("truncated_count"),
    )
    status = (
        F.when(F.col("requested_count") == 0, "not_needed")
        .when((F.col("model_count") > 0) & (F.col("fallback_count") == 0), "model")
        .when(F.col("model_count") > 0, "mixed")
        .otherwise("fallback")
    )
    return counts.withColumn("status", status)
