"""Rule evaluation and the finding of every submitted ingredient.

All inputs of a rule's decision except the amount are categories, so decisions are made once per
distinct (name, number, context, unit, basis, stage). Only the comparison with the limit is left for
the fact rows: one join, then column expressions.

The rules of a substance are nested in one row. Rule ids are the record's reference plus at most one
case letter, so that list has at most 27 entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import constants as K
from assayer.functions.text import absent_apart, present, text_key, value_keys
from assayer.operators import resolve as R

NO_STRINGS = "array<string>"
IDENTITY_COLUMNS = (
    "status", "substance_id", "match_methods", "identity_source_type", "reasons", "catalogue_ingredient_id",
    "catalogue_name",
)


def _none() -> Column:
    return F.array().cast(NO_STRINGS)


def flat_ingredients(ingredients: DataFrame) -> DataFrame:
    """Concentration fields as top-level columns; ``has_amount`` tells an absent concentration."""
    return ingredients.select(
        "formulation_id",
        "row_number",
        "name",
        "cas_number",
        "product_context",
        F.col("concentration").isNotNull().alias("has_amount"),
        F.col("concentration.value").alias("value"),
        F.col("concentration.unit").alias("unit"),
        F.col("concentration.basis").alias("basis"),
        F.col("concentration.preparation_stage").alias("preparation_stage"),
    )


def applicable_rules(rules: DataFrame) -> DataFrame:
    """Controlling rules nested per substance, in rule-id order, with their comparison keys."""
    optional = {
        "unresolved_current_applicability": F.lit(False),
        "other_conditions": F.lit(None).cast("string"),
        "required_warning": F.lit(None).cast("string"),
    }
    source = rules
    for name, default in optional.items():
        if name not in rules.columns:
            source = source.withColumn(name, default)
    limit = F.col("concentration")
    keyed = source.filter(
        F.col("regulatory_section").isin(*K.CONTROLLING_SECTIONS) & F.col("substance_id").isNotNull()
    ).select(
        "substance_id",
        F.struct(
            "rule_id",
            "regulatory_section",
            "reference_number",
            "substance_name",
            (~F.col("active") | (F.col("normalization_status") == "inactive_source_entry")).alias("inactive"),
            F.coalesce("unresolved_current_applicability", F.lit(False)).alias("open_inactive"),
            (F.col("regulatory_section") == K.PROHIBITED_SECTION).alias("prohibited"),
            (F.col("normalization_status") == "normalized").alias("normalized"),
            "review_reasons",
            F.when(F.coalesce("product_context", F.lit("")) != "", text_key(F.col("product_context"))).alias("context"),
            F.col("product_context").alias("context_text"),
            limit.isNotNull().alias("has_limit"),
            limit["value"].cast("double").alias("value"),
            limit["unit"].alias("limit_unit"),
            limit["comparator"].alias("comparator"),
            limit["preparation_stage"].alias("limit_stage"),
            F.when(limit["unit"].isNotNull(), text_key(limit["unit"])).alias("unit"),
            F.when(limit["basis"].isNotNull(), text_key(limit["basis"])).alias("basis"),
            F.when(limit["preparation_stage"].isNotNull(), text_key(limit["preparation_stage"])).alias("stage"),
            present(F.col("other_conditions")).alias("has_conditions"),
            present(F.col("required_warning")).alias("has_warning"),
        ).alias("rule"),
    )
    return keyed.groupBy("substance_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def limit_mismatch(rule: Column, unit: Column, basis: Column, stage: Column) -> Column:
    """Names of unequal fields in fixed order; null equals null only."""
    return F.array_compact(
        F.array(
            F.when(~rule["unit"].eqNullSafe(unit), "unit"),
            F.when(~rule["basis"].eqNullSafe(basis), "basis"),
            F.when(~rule["stage"].eqNullSafe(stage), "preparation_stage"),
        )
    )


def _branch(rule: Column, df_mismatch: Column) -> Column:
    """First decision that holds for a rule; ``compare`` leaves the limit to the fact row."""
    context_open = rule["context"].isNotNull() & (rule["context"] != "all products")
    return (
        F.when(rule["inactive"], F.when(rule["open_inactive"], "inactive_open").otherwise("inactive"))
        .when(rule["prohibited"], F.when(rule["normalized"], "prohibited").otherwise("prohibition_review"))
        .when(context_open & F.col("_context").isNull(), "context_missing")
        .when(~rule["normalized"], "restriction_review")
        .when(context_open & ~F.col("_context_known"), "context_unknown")
        .when(context_open & (F.col("_context") != rule["context"]), "other_context")
        .when(~rule["has_limit"], "no_limit")
        .when(F.coalesce(rule["stage"], F.lit("")).isin("", "unspecified"), "stage_open")
        .when(~F.col("has_amount"), "amount_missing")
        .when(F.size(df_mismatch) > 0, "incompatible")
        .when(
            ~F.coalesce(rule["comparator"], F.lit("")).isin("less_than_or_equal", "less_than") | rule["value"].isNull(),
            "unsupported",
        )
        .otherwise("compare")
    )


def _evaluation(step: Column) -> Column:
    rule, branch = step["rule"], step["branch"]

    def told(text: str | Column) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        return F.concat(rule["rule_id"], F.lit(": "), text)

    single = (
        F.when(branch == "inactive_open", told("inactive record has unresolved current applicability"))
        .when(branch == "context_missing", told("product context is required"))
        .when(branch == "context_unknown", told("submitted product context is not an exact source-backed context"))
        .when(branch == "no_limit", told("normalized restriction has no executable concentration constraint"))
        .when(branch == "stage_open", told("source preparation stage is not sufficiently specified for comparison"))
        .when(branch == "amount_missing", told("concentration value, unit, basis, and stage are required"))
        .when(
            branch == "incompatible",
            told(F.concat(F.lit("incompatible "), F.array_join(step["mismatch"], ", "), F.lit("; no conversion performed"))),
        )
        .when(branch == "unsupported", told("unsupported comparator or numerical limit"))
    )
    own = F.when(F.size(rule["review_reasons"]) > 0, rule["review_reasons"]).otherwise(
        F.when(branch == "prohibition_review", F.array(F.lit("prohibition semantics require professional review"))).otherwise(
            F.array(F.lit("restriction semantics require professional review"))
        )
    )
    ancillary = F.array_compact(
        F.array(
            F.when(rule["has_conditions"], "other regulatory requirements were returned as evidence but not evaluated"),
            F.when(rule["has_warning"], "required warning was returned as evidence but not evaluated"),
        )
    )
    reasons = (
        F.when(single.isNotNull(), F.array(single))
        .when(branch.isin("prohibition_review", "restriction_review"), own)
        .when(branch == "compare", ancillary)
        .otherwise(_none())
    )
    review = (
        F.when(branch.isin("context_missing", "amount_missing"), _none())
        .when(single.isNotNull(), F.array(single))
        .otherwise(F.transform(reasons, lambda r: told(r)))
    )
    return F.struct(
        rule["rule_id"].alias("rule_id"),
        rule["regulatory_section"].alias("regulatory_section"),
        rule["reference_number"].alias("reference_number"),
        rule["substance_name"].alias("substance_name"),
        branch.alias("branch"),
        F.when(branch.isin("context_missing", "amount_missing"), "withheld_information_missing")
        .when(branch.isin("prohibited", "compare"), "deterministic")
        .when(branch == "other_context", "not_applicable_to_submitted_context")
        .when(branch == "inactive", "inactive")
        .otherwise("withheld_professional_review")
        .alias("evaluation_status"),
        reasons.alias("reasons"),
        review.alias("review_reasons"),
        rule["value"].alias("limit_value"),
        rule["limit_unit"].alias("limit_unit"),
        rule["limit_stage"].alias("limit_stage"),
        rule["comparator"].alias("comparator"),
        rule["context_text"].alias("product_context"),
    )


def screening_requests(ingredients: DataFrame) -> DataFrame:
    """Distinct category combinations of the submitted rows."""
    return flat_ingredients(ingredients).select(*R.REQUEST_COLUMNS, "has_amount").distinct()


def evaluate_requests(requests: DataFrame, resolved: DataFrame, nested_rules: DataFrame, contexts: DataFrame) -> DataFrame:
    """Identity, evaluations and everything about the finding that does not need the amount."""
    identity = resolved.select("name", "cas_number", *IDENTITY_COLUMNS)
    known = contexts.select(F.col("context_key").alias("_context"), F.lit(True).alias("_known"))
    keys = {"_context": "product_context", "_unit": "unit", "_basis": "basis", "_stage": "preparation_stage"}
    given = {c: present(F.col(c)) if c == "product_context" else F.col(c).isNotNull() for c in keys.values()}
    keyed = value_keys(requests, keys).withColumns({out: F.when(given[c], F.col(out)) for out, c in keys.items()})
    joined = (
        null_safe_join(keyed, identity, ("name", "cas_number"), "inner")
        .join(known, "_context", "left")
        .withColumn("_context_known", F.col("_context").isNull() | F.coalesce("_known", F.lit(False)))
        .withColumn("_rule_join", absent_apart(F.col("substance_id"), F.col("name"), F.col("cas_number"), F.col("unit")))
        .join(nested_rules.withColumnRenamed("substance_id", "_rule_join"), "_rule_join", "left")
    )
    rules = F.when(F.col("status") == "resolved", F.col("rules"))
    checked = F.transform(
        rules,
        lambda r: F.struct(r.alias("rule"), limit_mismatch(r, F.col("_unit"), F.col("_basis"), F.col("_stage")).alias("mismatch")),
    )
    steps = F.transform(
        checked,
        lambda s: F.struct(s["rule"].alias("rule"), _branch(s["rule"], s["mismatch"]).alias("branch"), s["mismatch"].alias("mismatch")),
    )
    staged = joined.withColumn("_steps", steps)
    evaluated = staged.withColumn("_all", F.transform("_steps", _evaluation))
    shown = F.filter("_all", lambda e: e["branch"] != "inactive")
    identity_open = F.col("status") != "resolved"
    return evaluated.select(
        *R.REQUEST_COLUMNS,
        "has_amount",
        *[c for c in IDENTITY_COLUMNS if c != "reasons"],
        F.col("reasons").alias("identity_reasons"),
        F.coalesce(shown, F.array().cast(evaluated.schema["_all"].dataType)).alias("evaluations"),
        F.coalesce(
            F.transform(
                F.filter("_steps", lambda s: s["branch"].isin("inactive", "inactive_open")), lambda s: s["rule"]["rule_id"]
            ),
            _none(),
        ).alias("inactive_rules"),
        F.when(identity_open, F.col("reasons"))
        .otherwise(
            F.array_distinct(
                F.flatten(F.transform(F.coalesce("_all", F.array().cast(evaluated.schema["_all"].dataType)), lambda e: e["review_reasons"]))
            )
        )
        .alias("review_reasons"),
        F.coalesce(F.exists("_all", lambda e: e["branch"] == "prohibited"), F.lit(False)).alias("_prohibited"),
        F.coalesce(F.exists("_all", lambda e: e["branch"].isin("context_missing", "amount_missing")), F.lit(False)).alias(
            "_missing"
        ),
        F.coalesce(
            F.transform(
                F.filter("_all", lambda e: e["branch"] == "compare"),
                lambda e: F.struct(e["limit_value"].alias("limit"), (e["comparator"] == "less_than").alias("strict")),
            ),
            F.array().cast("array<struct<limit:double,strict:boolean>>"),
        ).alias("_limits"),
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Equi-join in which null keys match null keys; the key columns appear once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = None
    for key in keys:
        part = left[key].eqNullSafe(renamed[f"_r_{key}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def is_within(value: Column, limit: Column, strict: Column) -> Column:
    return F.when(strict, value < limit).otherwise(value <= limit)


def screen_ingredients(ingredients: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One result per submitted row. The fact table is read once and joined once."""
    facts = flat_ingredients(ingredients)
    df = null_safe_join(facts, evaluated, (*R.REQUEST_COLUMNS, "has_amount"), "inner")
    within = F.exists("_limits", lambda l: is_within(F.col("value"), l["limit"], l["strict"]))
    exceeded = F.exists("_limits", lambda l: ~is_within(F.col("value"), l["limit"], l["strict"]))
    finding = lambda e: F.when(e["branch"] == "prohibited", K.PROHIBITED).when(
        e["branch"] == "compare",
        F.when(
            is_within(F.col("value"), e["limit_value"], e["comparator"] == "less_than"), K.WITHIN_LIMIT
        ).otherwise(K.EXCEEDED),
    )
    df = (
        df.withColumn("_within", within)
        .withColumn("_exceeded", exceeded)
        .withColumn("evaluations", F.transform("evaluations", lambda e: e.withField("finding", finding(e))))
    )
    reviewed = F.size("review_reasons") > 0
    identity_open = F.col("status") != "resolved"
    primary = (
        F.when(F.col("status") == "unresolved", K.UNRESOLVED)
        .when(identity_open, K.REVIEW)
        .when(F.col("_prohibited"), K.PROHIBITED)
        .when(F.col("_exceeded"), K.EXCEEDED)
        .when(reviewed, K.REVIEW)
        .when(F.col("_missing"), K.MISSING)
        .when(F.col("_within"), K.WITHIN_LIMIT)
        .otherwise(K.NO_ISSUE)
    )
    return df.select(
        "formulation_id",
        "row_number",
        "name",
        "cas_number",
        "product_context",
        "has_amount",
        "value",
        "unit",
        "basis",
        "preparation_stage",
        "status",
        "substance_id",
        "match_methods",
        "identity_source_type",
        "identity_reasons",
        "catalogue_ingredient_id",
        "catalogue_name",
        primary.alias("primary_finding"),
        F.array_distinct(F.array_compact(F.transform("evaluations", lambda e: e["finding"]))).alias("confirmed_findings"),
        (identity_open | reviewed).alias("review_required"),
        F.when(identity_open, "identity_review").when(reviewed, "rule_review").alias("review_type"),
        "review_reasons",
        "evaluations",
        "inactive_rules",
    )


def rule_evaluations(results: DataFrame) -> DataFrame:
    """One row per (submitted row, rule) that was evaluated."""
    return results.select("formulation_id", "row_number", "primary_finding", "confirmed_findings", F.explode("evaluations").alias("e")).select(
        "formulation_id", "row_number", "primary_finding", "confirmed_findings", "e.*"
    )


def inactive_evidence(results: DataFrame) -> DataFrame:
    """Inactive rules of resolved rows, listed apart from the evaluations."""
    listed = results.select(
        "formulation_id",
        "row_number",
        F.transform(F.filter("evaluations", lambda e: e["branch"] == "inactive_open"), lambda e: e["rule_id"]).alias("_open"),
        F.explode("inactive_rules").alias("rule_id"),
    )
    return listed.select(
        "formulation_id", "row_number", "rule_id", F.array_contains("_open", F.col("rule_id")).alias("needs_review")
    )


def supporting(results: DataFrame) -> Column:
    """Evaluations that back the shown finding, as an array column of ``results``."""
    e = F.col("evaluations")
    primary = F.filter(e, lambda x: x["finding"] == F.col("primary_finding"))
    support = primary

    def deterministic(finding: str) -> Column:
        return F.filter(e, lambda x: (x["evaluation_status"] == "deterministic") & (x["finding"] == finding))

    for finding in reversed(K.SUPPORT_ORDER):
        # first confirmed finding, in precedence order, that has a deterministic evaluation
        rows = deterministic(finding)
        usable = F.array_contains("confirmed_findings", F.lit(finding)) & (F.size(rows) > 0)
        support = F.when(usable, rows).otherwise(support)
    return F.when(F.size(primary) > 0, primary).otherwise(support)


def supporting_evaluations(results: DataFrame) -> DataFrame:
    return results.select(
        "formulation_id", "row_number", "primary_finding", F.explode(supporting(results)).alias("e")
    ).select("formulation_id", "row_number", "primary_finding", "e.rule_id", "e.finding", "e.evaluation_status")


def finding_display_name(results: DataFrame, substances: DataFrame) -> DataFrame:
    """Name shown for a result: supporting rule, resolved substance, catalogue, else as submitted."""
    names = substances.select(F.col("substance_id").alias("_name_join"), F.col("original_substance_name").alias("_resolved"))
    df = (
        results.withColumn("_support", F.get(supporting(results), F.lit(0))["substance_name"])
        .withColumn("_name_join", absent_apart(F.col("substance_id"), F.col("formulation_id"), F.col("row_number")))
        .join(names, "_name_join", "left")
    )
    backed = F.coalesce("_support", "_resolved", "catalogue_name")
    at = F.instr(F.lower(backed), " (except ")
    shown = F.when(at > 0, F.substr(backed, F.lit(1), at - 1)).otherwise(backed)
    return df.select("formulation_id", "row_number", F.coalesce(shown, F.col("name")).alias("display_name"))


def rule_evidence(rules: DataFrame, links: DataFrame, provisions: DataFrame) -> DataFrame:
    """Evidence of controlling rules in long form: (owner, kind, item, status).

    Provisions and cross-references belong to a rule. Advisory counterparts belong to the
    cross-reference, so they are listed once and not once per rule.
    """
    controlling = rules.filter(F.col("regulatory_section").isin(*K.CONTROLLING_SECTIONS))
    wanted = F.create_map(
        *[x for s, ids in K.SECTION_PROVISIONS.items() for x in (F.lit(s), F.array(*[F.lit(i) for i in ids]))]
    )
    provision_rows = (
        controlling.select("rule_id", F.explode(F.element_at(wanted, F.col("regulatory_section"))).alias("provision_id"))
        .join(provisions.select("provision_id"), "provision_id")
        .select(F.col("rule_id").alias("owner"), F.lit("provision").alias("kind"), F.col("provision_id").alias("item"), F.lit(None).cast("string").alias("status"))
    )
    own = links.filter("side = 'singapore'").select("rule_id", "cross_reference_id", "comparison_status")
    xref_rows = own.select(F.col("rule_id").alias("owner"), F.lit("cross_reference").alias("kind"), F.col("cross_reference_id").alias("item"), F.col("comparison_status").alias("status"))
    advisory = links.filter("side = 'acd'").select("cross_reference_id", F.col("rule_id").alias("_advisory"))
    counterpart_rows = links.filter("side = 'acd'").select(
        F.col("cross_reference_id").alias("owner"),
        F.lit("counterpart").alias("kind"),
        F.col("rule_id").alias("item"),
        F.lit(None).cast("string").alias("status"),
    )
    return provision_rows.unionByName(xref_rows).unionByName(counterpart_rows.distinct())


#: What stands for a raw record without fragments, as far as it has them: fixed names that must match.
RAW_FIELDS = (
    "raw_record_id", "page", "pages", "row_bbox", "cell_bboxes", "row_fragments", "original_cells", "source_text", "original_row_text",
)
EVIDENCE_FIELDS = (
    "rule_id", "source_document", "source_version", "effective_date", "document_revision", "retrieval_date", "source_url", "regulatory_section",
    "reference_number", "substance_name", "product_context", "concentration", "other_conditions", "required_warning", "source_text",
    "source_pages", "normalization_status", "review_reasons", "raw_record_id",
)


def evidence_record(rules: DataFrame) -> DataFrame:
    """The rule itself as evidence: its texts, sources and review state; fields that the table lacks are left out."""
    return rules.select(*[c for c in EVIDENCE_FIELDS if c in rules.columns])


def evidence_fragments(rules: DataFrame, raw: DataFrame) -> DataFrame:
    """(rule_id, position, fragment): the raw source of each rule, as JSON objects.

    A record's fragments in their order, each with the record's id; a record without fragments stands for itself
    with those of RAW_FIELDS that it has. Rules of either side have fragments, so counterparts need no copy of their own.
    """
    own = [c for c in RAW_FIELDS if c in raw.columns]
    whole = F.array(F.to_json(F.struct(*own)))
    fragments = whole
    if "fragments" in raw.columns:
        names = raw.schema["fragments"].dataType.elementType.names
        each = F.transform("fragments", lambda f: F.to_json(F.struct("raw_record_id", *[f[n].alias(n) for n in names])))
        fragments = F.when(F.coalesce(F.size("fragments"), F.lit(0)) > 0, each).otherwise(whole)
    shown = raw.select("raw_record_id", F.posexplode(fragments).alias("position", "fragment"))
    return rules.select("rule_id", "raw_record_id").join(shown, "raw_record_id").select("rule_id", "position", "fragment")


def evidence_provisions(rules: DataFrame, provisions: DataFrame) -> DataFrame:
    """(rule_id, position, provision): the provisions that a rule's section cites, in their order, with their metadata.

    provisions: as from ``provision_snapshot``; cited ones that are absent leave a gap.
    """
    cited = F.create_map(
        *[x for s, ids in K.SECTION_PROVISIONS.items() for x in (F.lit(s), F.array(*[F.lit(i) for i in ids]))]
    )
    wanted = rules.select("rule_id", F.posexplode(F.element_at(cited, F.col("regulatory_section"))).alias("position", "provision_id"))
    return wanted.join(provisions, "provision_id").select("rule_id", "position", *provisions.columns)
