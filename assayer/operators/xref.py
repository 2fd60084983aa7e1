"""Comparison of the advisory and the controlling rule snapshot.

Rules of both sides meet in one aggregation instead of a join: every rule is tagged with its mapping
and side and numbered within its case by rule id, then grouped by (mapping, reference, case label, number). So
each group holds at most one rule of a side, also where a snapshot repeats a case, and no group grows with
a reference. Numbers come from sorted range partitions, so a very common case is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import constants as K
from assayer.functions.text import text_key
from assayer.operators.ordering import numbered
from assayer.session import materialize

PROHIBITED_FIELDS = ("substance_name",)
RESTRICTED_FIELDS = (
    "substance_name",
    "product_context",
    "concentration_text",
    "concentration",
    "other_conditions",
    "required_warning",
)


def canonical_json(value: Column, fields: list[str]) -> Column:
    """JSON text of a struct with sorted keys, ``, `` and ``: `` separators and nulls kept."""

    def shown(name: str) -> Column:
        quoted = F.to_json(F.array(value.getField(name)), {"ignoreNullFields": "false"})
        return F.concat(F.lit(f'"{name}": '), F.substr(quoted, F.lit(2), F.length(quoted) - 2))

    return F.when(
        value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *[shown(n) for n in sorted(fields)]), F.lit("}"))
    )


def sides(rules: DataFrame, mappings: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Rules tagged with mapping, side (acd / singapore), reference key, case label and field texts."""
    mappings = mappings or K.SECTION_MAPPINGS
    by_section = {}
    for name, (advisory, controlling) in mappings.items():
        by_section[advisory] = (name, "acd")
        by_section[controlling] = (name, "singapore")
    mapping, side = F.lit(None).cast("string"), F.lit(None).cast("string")
    for section, (name, which) in by_section.items():
        here = F.col("regulatory_section") == section
        mapping = F.when(here, name).otherwise(mapping)
        side = F.when(here, which).otherwise(side)
    tagged = rules.filter(F.col("regulatory_section").isin(*by_section)).select(
        "*",
        mapping.alias("regulatory_mapping"),
        side.alias("_side"),
        F.lower("reference_number").alias("reference_key"),
        F.coalesce("case_label", F.lit("parent")).alias("_label"),
    )
    return tagged


def _field_texts(df: DataFrame, fields: tuple[str, ...]) -> list[tuple[str, Column]]:
    texts = []
    for field in fields:
        if field not in df.columns:
            continue
        kind = df.schema[field].dataType
        value = canonical_json(F.col(field), kind.names) if hasattr(kind, "names") else F.col(field)
        texts.append((field, F.coalesce(value, F.lit(""))))
    return texts


def group_rules_by_reference(
    rules: DataFrame,
    fields: tuple[str, ...] = RESTRICTED_FIELDS,
    mappings: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per (mapping, reference, case label, case number) with both sides' rule and fields.

    The rules of a case are numbered by id on each side; the n-th of one side is compared with the n-th of the other.
    """
    tagged = sides(rules, mappings)
    texts = _field_texts(tagged, fields)
    case = ["regulatory_mapping", "reference_key", "_label"]
    keyed = tagged.select(
        *case, "_side", "reference_number", "rule_id",
        *[text.alias(f"_v_{name}") for name, text in texts],
        *[text_key(text).alias(f"_k_{name}") for name, text in texts],
    )
    # An accepted snapshot repeats no case: then every number is 0 and nothing needs to be sorted.
    repeated = keyed.groupBy(*case, "_side").agg(F.count("*").alias("_n")).filter("_n > 1")
    if repeated.isEmpty():
        keyed = keyed.withColumn("case_number", F.lit(0).cast("bigint"))
    else:
        keyed = numbered(keyed, [*case, "_side"], ["rule_id"], "case_number")
    payload = F.struct(
        "rule_id", "reference_number",
        *[F.col(f"_v_{name}") for name, _ in texts], *[F.col(f"_k_{name}") for name, _ in texts],
    )
    aggregates = []
    for side in ("acd", "singapore"):
        here = F.col("_side") == side
        aggregates += [F.count_if(here).alias(f"{side}_count"), F.min(F.when(here, payload)).alias(f"{side}_rule")]
    grouped = keyed.groupBy(*case, "case_number").agg(*aggregates)
    both = (F.col("acd_count") > 0) & (F.col("singapore_count") > 0)
    restricted = F.col("regulatory_mapping").startswith("annex-iii")
    differences = []
    for name, _ in texts:
        compared = F.lit(True) if name in PROHIBITED_FIELDS else restricted
        unequal = F.col(f"acd_rule._k_{name}") != F.col(f"singapore_rule._k_{name}")
        differences.append(
            F.when(
                both & compared & unequal,
                F.struct(
                    F.lit(name).alias("field"),
                    F.col(f"acd_rule._v_{name}").alias("acd"),
                    F.col(f"singapore_rule._v_{name}").alias("singapore"),
                ),
            )
        )
    return grouped.select(
        "regulatory_mapping",
        "reference_key",
        F.col("_label").alias("case_label"),
        "case_number",
        "acd_count",
        "singapore_count",
        F.col("acd_rule.rule_id").alias("acd_rule_id"),
        F.col("singapore_rule.rule_id").alias("singapore_rule_id"),
        F.coalesce("acd_rule.reference_number", "singapore_rule.reference_number").alias("reference_number"),
        F.array_compact(F.array(*differences)).alias("differences"),
        F.struct(*[F.col(f"acd_rule._v_{n}").alias(n) for n, _ in texts]).alias("acd_values"),
        F.struct(*[F.col(f"singapore_rule._v_{n}").alias(n) for n, _ in texts]).alias("singapore_values"),
    )


def compare_snapshots(
    rules: DataFrame,
    fields: tuple[str, ...] = RESTRICTED_FIELDS,
    mappings: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per reference of either side with its comparison status."""
    cases = group_rules_by_reference(rules, fields, mappings)
    headers = cases.groupBy("regulatory_mapping", "reference_key").agg(
        F.coalesce(
            F.min(F.when(F.col("acd_count") > 0, F.col("reference_number"))), F.min("reference_number")
        ).alias("reference_number"),
        F.sum("acd_count").alias("acd_rules"),
        F.sum("singapore_count").alias("singapore_rules"),
        F.bool_or(F.col("acd_count") != F.col("singapore_count")).alias("_cases_differ"),
        F.bool_or(F.size("differences") > 0).alias("_fields_differ"),
        *[
            F.bool_or(F.array_contains(F.transform("differences", lambda d: d["field"]), name)).alias(f"_differs_{name}")
            for name in fields
        ],
    )
    ranged = F.col("reference_number").rlike(K.RANGE_PATTERN)
    both = (F.col("acd_rules") > 0) & (F.col("singapore_rules") > 0)
    status = (
        F.when(ranged, "ambiguous")
        .when(both & F.col("_cases_differ"), "ambiguous")
        .when(both & F.col("_fields_differ"), "changed")
        .when(both, "aligned")
        .when(F.col("acd_rules") > 0, "acd_only")
        .otherwise("singapore_only")
    )
    # used twice below: for its one-sided references and for the result
    headers = materialize(headers.withColumn("comparison_status", status), "comparison-headers")
    candidates = rename_candidates(headers, rules, mappings)
    headers = headers.join(
        candidates.groupBy("regulatory_mapping", "reference_key").agg(
            F.sum("candidate_count").alias("candidate_count"), F.min("first_candidate").alias("first_candidate")
        ),
        ["regulatory_mapping", "reference_key"],
        "left",
    )
    reasons = F.array_sort(
        F.array_compact(
            F.array(
                F.when(ranged, "ranged_reference_prevents_unique_entry_correspondence"),
                F.when(~ranged & both & F.col("_cases_differ"), "normalized_case_structure_differs_between_sources"),
                F.when(F.col("comparison_status") == "changed", "source_wording_or_regulatory_field_differs"),
                F.when(F.col("comparison_status") == "acd_only", "no_current_singapore_reference_number_match"),
                F.when(F.col("comparison_status") == "singapore_only", "no_acd_2026_1_reference_number_match"),
                F.when(
                    F.col("candidate_count") > 0, "same_normalized_substance_name_found_under_different_reference"
                ),
            )
        )
    )
    changed = F.col("comparison_status") == "changed"
    return headers.select(
        F.concat(
            F.lit("xref-"), "regulatory_mapping", F.lit("-"), F.replace("reference_key", F.lit(" "), F.lit("-"))
        ).alias("cross_reference_id"),
        "regulatory_mapping",
        "reference_key",
        "reference_number",
        "acd_rules",
        "singapore_rules",
        F.when(both, "reference_number").otherwise("unmatched").alias("match_basis"),
        "comparison_status",
        F.array_compact(F.array(*[F.when(changed & F.col(f"_differs_{n}"), F.lit(n)) for n in fields])).alias(
            "changed_fields"
        ),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        "first_candidate",
        (F.col("comparison_status") != "aligned").alias("professional_review_required"),
        reasons.alias("review_reasons"),
    )


def case_differences(
    rules: DataFrame,
    cross_references: DataFrame,
    fields: tuple[str, ...] = RESTRICTED_FIELDS,
    mappings: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Both originals of each case, for every field that makes a reference ``changed``: one row per case and field.

    cross_reference_id, field, case_label, case_number, acd_rule_id, singapore_rule_id, acd, singapore, differs.
    """
    cases = group_rules_by_reference(rules, fields, mappings)
    keys = ["regulatory_mapping", "reference_key"]
    changed = cross_references.filter(F.col("comparison_status") == "changed").select(
        *keys, "cross_reference_id", F.explode("changed_fields").alias("field")
    )
    names = [f for f in fields if f in cases.schema["acd_values"].dataType.names]
    value = {
        side: F.coalesce(*[F.when(F.col("field") == n, F.col(f"{side}_values.{n}")) for n in names])
        for side in ("acd", "singapore")
    }
    return changed.join(cases, keys).select(
        "cross_reference_id", "field", "case_label", "case_number", "acd_rule_id", "singapore_rule_id",
        value["acd"].alias("acd"), value["singapore"].alias("singapore"),
        F.exists("differences", lambda d: d["field"] == F.col("field")).alias("differs"),
    )


def field_differences(
    rules: DataFrame,
    cross_references: DataFrame,
    fields: tuple[str, ...] = RESTRICTED_FIELDS,
    mappings: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Both originals of every field that makes a reference ``changed``, each as one text for display.

    A side's text lists its cases as ``[label] value``: the rows of ``case_differences``, which stay apart where
    a reference has very many.
    """
    rows = case_differences(rules, cross_references, fields, mappings)
    # the parent entry sorts before lettered cases
    rank = F.when(F.col("case_label") == "parent", "").otherwise(F.col("case_label"))

    def listed(side: str) -> Column:
        line = F.concat(F.lit("["), "case_label", F.lit("] "), side)
        ordered = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "case_number", line.alias("line"))))
        return F.array_join(F.transform(ordered, lambda s: s["line"]), "\n---\n").alias(side)

    return rows.groupBy("cross_reference_id", "field").agg(listed("acd"), listed("singapore"))


def rename_candidates(
    headers: DataFrame, rules: DataFrame, mappings: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """One-sided references whose name is active on the other side under another reference.

    The other side is first reduced to one row per name (how many references, the first of them), so
    a name shared by very many entries never meets itself pairwise. ``name_references`` lists them.
    """
    index = name_references(rules, mappings).groupBy("regulatory_mapping", "_side", "name_key").agg(
        F.count("*").alias("candidate_count"), F.min("reference_key").alias("_first")
    )
    names = (
        sides(rules, mappings)
        .select("regulatory_mapping", "reference_key", text_key(F.col("substance_name")).alias("name_key"))
        .filter("name_key <> ''")
        .distinct()
    )
    one_sided = headers.filter(F.col("comparison_status").isin("acd_only", "singapore_only")).select(
        "regulatory_mapping",
        "reference_key",
        F.when(F.col("comparison_status") == "acd_only", "singapore").otherwise("acd").alias("_side"),
    )
    return (
        one_sided.join(names, ["regulatory_mapping", "reference_key"])
        .join(index, ["regulatory_mapping", "_side", "name_key"])
        .select(
            "regulatory_mapping",
            "reference_key",
            "name_key",
            "candidate_count",
            F.concat(F.col("_side"), F.lit(":"), F.col("_first")).alias("first_candidate"),
        )
    )


def rename_candidate_rows(
    headers: DataFrame, rules: DataFrame, mappings: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Every candidate of every one-sided reference: (mapping, reference, name, candidate), ``side:reference`` as candidate.

    The full list for reading; its size is that of the answer. ``rename_candidates`` with ``name_references`` holds the
    same without pairing the references of a very common name.
    """
    found = rename_candidates(headers, rules, mappings).select(
        "regulatory_mapping", "reference_key", "name_key", F.substring_index("first_candidate", ":", 1).alias("_side")
    )
    other = name_references(rules, mappings).withColumnRenamed("reference_key", "_other")
    return found.join(other, ["regulatory_mapping", "_side", "name_key"]).select(
        "regulatory_mapping", "reference_key", "name_key", F.concat("_side", F.lit(":"), "_other").alias("candidate")
    )


def name_references(rules: DataFrame, mappings: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Distinct references of each active name, by mapping and side."""
    return (
        sides(rules, mappings)
        .filter("active")
        .select(
            "regulatory_mapping", "_side", text_key(F.col("substance_name")).alias("name_key"), "reference_key"
        )
        .filter("name_key <> ''")
        .distinct()
    )


def cross_reference_rules(
    rules: DataFrame, cross_references: DataFrame, mappings: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Which rules a cross-reference covers, one row per rule."""
    return (
        sides(rules, mappings)
        .join(
            cross_references.select("regulatory_mapping", "reference_key", "cross_reference_id", "comparison_status"),
            ["regulatory_mapping", "reference_key"],
        )
        .select(
            "cross_reference_id", "comparison_status", F.col("_side").alias("side"), "rule_id", "substance_id",
            "active", "reference_number",
        )
    )


def snapshot_bridge(links: DataFrame) -> DataFrame:
    """Advisory substance -> controlling substance of the same cross-reference, with its status.

    A substance id is made from section and reference, so after ``distinct`` a cross-reference has
    one substance per side and the join does not multiply rows.
    """
    known = links.filter("substance_id is not null")
    advisory = known.filter("side = 'acd'").select(
        "cross_reference_id", F.col("substance_id").alias("advisory_substance_id")
    )
    controlling = known.filter("side = 'singapore'").select(
        "cross_reference_id", "comparison_status", F.col("substance_id").alias("controlling_substance_id")
    )
    return (
        advisory.distinct()
        .join(controlling.distinct(), "cross_reference_id")
        .select("advisory_substance_id", "controlling_substance_id", "comparison_status")
        .distinct()
    )


_LIMIT_SCHEMA = (
    "struct<value:double,unit:string,comparator:string,basis:string,preparation_stage:string,source_text:string>"
)


def comparison_rows(differences: DataFrame) -> DataFrame:
    """Display rows of field differences; a limit known on both sides becomes four rows."""
    from assayer.functions import labels

    def plain(value: Column) -> Column:
        bare = F.regexp_replace(value, r"^\[parent\]\s?", "")
        return F.when(F.coalesce(bare, F.lit("")) == "", "—").otherwise(bare)

    parsed = differences.select(
        "*",
        *[
            F.when(plain(F.col(side)).startswith("{"), F.from_json(plain(F.col(side)), _LIMIT_SCHEMA)).alias(f"_{side}")
            for side in ("acd", "singapore")
        ],
    )
    both = (F.col("field") == "concentration") & F.col("_acd").isNotNull() & F.col("_singapore").isNotNull()

    def row(title: str, render) -> Column:
        return F.struct(
            F.lit(title).alias("field"), render(F.col("_acd")).alias("acd"), render(F.col("_singapore")).alias("singapore")
        )

    four = F.array(
        row("Maximum concentration", labels.rule_concentration),
        row("Comparator", lambda s: labels.comparator(s["comparator"])),
        row("Concentration basis", lambda s: F.coalesce(s["basis"], F.lit("No specific basis"))),
        row("Preparation stage", lambda s: labels.preparation_stage(s["preparation_stage"])),
    )
    one = F.array(
        F.struct(
            labels.field_name(F.col("field")).alias("field"),
            plain(F.col("acd")).alias("acd"),
            plain(F.col("singapore")).alias("singapore"),
        )
    )
    return parsed.select("cross_reference_id", F.explode(F.when(both, four).otherwise(one)).alias("r")).select(
        "cross_reference_id", "r.field", "r.acd", "r.singapore"
    )
