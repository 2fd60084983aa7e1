"""Normalisation of raw table records into rules and substances, and the ingredient catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import constants as K
from assayer.functions import text as X

CASE_FIELDS = {
    "product_context": "original_field_of_use_text",
    "concentration_text": "original_concentration_text",
    "other_conditions": "original_conditions_text",
    "required_warning": "original_warning_text",
}
SUPPORTED_REFERENCE = (K.ADVISORY_PROHIBITED_SECTION, "419")


def _prohibited() -> Column:
    return F.col("section").isin(K.PROHIBITED_SECTION, K.ADVISORY_PROHIBITED_SECTION)


def record_facts(records: DataFrame) -> DataFrame:
    """Record-level facts: ids, activity, identifiers, aligned case labels and review reasons."""
    df = X.slug_ids(records).withColumn("_name", X.text_key(F.col("original_substance_name")))
    valid, malformed = X.harvested_identifiers(F.col("cas_number_raw"))
    df = (
        df.withColumn("active", X.is_active_entry(F.col("_name"), F.col("reference_number")))
        .withColumn("cas_numbers", valid)
        .withColumn("malformed_identifiers", malformed)
        .withColumn("restriction_type", F.when(_prohibited(), "prohibited").otherwise("restricted"))
        .withColumn("substance_id", F.when(F.col("active"), F.col("base_substance_id")))
    )
    for name, column in CASE_FIELDS.items():
        df = df.withColumn(f"_map_{name}", X.case_map(F.col(column)))
    maps = {name: F.col(f"_map_{name}") for name in CASE_FIELDS}
    split = (F.col("restriction_type") == "restricted") & F.col("active")
    df = df.withColumn("labels", F.when(split, X.aligned_labels(maps)))
    # lettered markers anywhere in the four fields
    markers = F.array_distinct(F.flatten(F.array(*[X.case_labels(F.col(c)) for c in CASE_FIELDS.values()])))
    any_map = F.coalesce(*[m.isNotNull() for m in maps.values()])
    for m in maps.values():
        any_map = any_map | m.isNotNull()
    unclear = ((F.size(markers) >= 2) | any_map) & F.col("labels").isNull()
    prohibited_active = (F.col("restriction_type") == "prohibited") & F.col("active")
    reasons = F.array_compact(
        F.array(
            F.when(F.size("malformed_identifiers") > 0, "malformed_cas_identifier_preserved"),
            F.when(
                F.exists("extraction_flags", lambda f: f != "entry_spans_multiple_pages"),
                "nonstandard_extraction_fragment",
            ),
            F.when(F.size("jurisdiction_notes") > 0, "jurisdiction_specific_source_wording"),
            F.when(unclear, "multi_case_mapping_not_unambiguous"),
            F.when(
                prohibited_active & X.any_phrase(F.col("_name"), K.CONDITIONAL_PHRASES),
                "conditional_prohibition_wording_not_structured",
            ),
            F.when(
                prohibited_active & F.col("_name").contains(K.NON_EXHAUSTIVE_PHRASE),
                "non_exhaustive_identifier_scope_not_structured",
            ),
            F.when(~F.col("active"), "blank_deleted_or_ranged_source_entry"),
        )
    )
    return df.withColumn("base_reasons", reasons)


def case_rows(facts: DataFrame) -> DataFrame:
    """One row per rule: the record itself, or one per aligned case.

    A case takes its part of a field, or the whole field where its part is missing or empty.
    """
    rows = facts.select("*", F.explode_outer("labels").alias("case_label"))
    out = rows
    for name, column in CASE_FIELDS.items():
        part = F.element_at(F.col(f"_map_{name}"), F.col("case_label"))
        own = F.when(F.coalesce(part, F.lit("")) != "", part).otherwise(F.col(column))
        out = out.withColumn(name, F.when(F.col("case_label").isNull(), F.col(column)).otherwise(own))
    return out.withColumn(
        "rule_id",
        F.concat(
            "base_rule_id",
            F.when(F.col("case_label").isNotNull(), F.concat(F.lit("-case-"), "case_label")).otherwise(""),
        ),
    ).withColumn("parent_rule_id", F.when(F.col("case_label").isNotNull(), F.col("base_rule_id")))


def limit_fallback(rows: DataFrame) -> DataFrame:
    """Limit of each rule and the reasons its text raises.

    An active restriction without a limit text may take a single limit from its conditions. A record
    whose cases could not be told apart has no limit at all.
    """
    df = rows.withColumn("_limit_key", X.text_key(F.col("concentration_text"))).withColumn(
        "_condition_key", X.text_key(F.col("other_conditions"))
    )
    default_stage = F.when(F.col("section") == K.ADVISORY_RESTRICTED_SECTION, "ready_for_use").otherwise("finished_product")
    own = X.parse_limit(F.col("concentration_text"), F.col("_limit_key"), "maximum_concentration", default_stage)
    other = X.parse_limit(F.col("other_conditions"), F.col("_condition_key"), "other_conditions", "unspecified")
    restricted = (F.col("restriction_type") == "restricted") & F.col("active")
    has_text = F.coalesce("concentration_text", F.lit("")) != ""
    hits = F.size(X.limit_hits(F.col("concentration_text"))) > 0
    condition_hits = F.size(X.limit_hits(F.col("other_conditions"))) > 0
    secondary = X.has_secondary_limit(F.col("other_conditions"))
    unclear = F.array_contains("base_reasons", "multi_case_mapping_not_unambiguous")
    any_number = (
        hits | condition_hits | secondary | X.has_secondary_limit(F.col("concentration_text"))
    )
    return (
        df.withColumn("_own", own)
        .withColumn("_other", F.when(restricted & ~has_text, other))
        .withColumn("concentration", F.when(~unclear, F.coalesce("_own", "_other")))
        .withColumn(
            "limit_reasons",
            F.array_compact(
                F.array(
                    F.when(
                        restricted & has_text & F.col("_own").isNull() & hits,
                        "concentration_contains_multiple_or_ambiguous_values",
                    ),
                    F.when(
                        restricted & ~has_text & F.col("_other").isNull() & condition_hits,
                        "concentration_condition_not_normalized",
                    ),
                    F.when(secondary, "additional_numeric_condition_not_structured"),
                    F.when(unclear & any_number, "ambiguous_multi_case_concentration_not_normalized"),
                )
            ),
        )
        .drop("_own", "_other", "_limit_key", "_condition_key")
    )


def rule_status(drafts: DataFrame) -> DataFrame:
    """Sorted distinct reasons and the status that follows from them."""
    reasons = F.array_sort(F.array_distinct(F.concat("base_reasons", "limit_reasons")))
    status = (
        F.when(~F.col("active"), "inactive_source_entry")
        .when(F.size(reasons) > 0, "manual_review_required")
        .otherwise("normalized")
    )
    return drafts.withColumn("review_reasons", reasons).withColumn("normalization_status", status)


def normalize_rules(records: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Rules of all raw records; ``sources`` adds version, hash and dates of the document."""
    drafts = rule_status(limit_fallback(case_rows(record_facts(records))))
    rules = drafts.select(
        "rule_id", "parent_rule_id", "case_label", "source_document", F.col("section").alias("regulatory_section"),
        "reference_number", "substance_id", F.col("original_substance_name").alias("substance_name"), "cas_numbers",
        "restriction_type", "product_context", "concentration", "concentration_text", "other_conditions",
        "required_warning", "jurisdiction_notes", "source_text", "source_pages", "raw_record_id", "active",
        "normalization_status", "review_reasons",
    )
    if sources is None:
        return rules
    return rules.join(
        sources.select(
            "source_document",
            F.col("document_revision").alias("source_version"),
            F.col("sha256").alias("source_hash"),
            "effective_date", "snapshot_generated_at", "source_url", "retrieval_date",
        ),
        "source_document",
    )


def normalize_substances(records: DataFrame) -> DataFrame:
    """One substance per active record."""
    return record_facts(records).filter("active").select(
        "substance_id", "source_document", F.col("section").alias("regulatory_section"), "reference_number",
        "original_substance_name", F.col("_name").alias("normalized_substance_name"), "cas_numbers",
        F.col("cas_number_raw").alias("identifiers_raw"), "malformed_identifiers", "source_pages", "raw_record_id", "active",
    )


def attach_footnotes(records: DataFrame, footnotes: DataFrame) -> DataFrame:
    """(raw_record_id, position, footnote_number, source_page, source_text) of cited footnotes."""
    cited = records.select(
        "raw_record_id", "source_document", F.posexplode("footnote_references").alias("position", "footnote_number")
    )
    return cited.join(footnotes, ["source_document", "footnote_number"]).select(
        "raw_record_id", "position", "footnote_number", "source_page", "source_text"
    )


def contributing_pages(records: DataFrame, attached: DataFrame, supporting: DataFrame | None = None) -> DataFrame:
    """Distinct (raw_record_id, source_page) over record, footnote and supporting-text pages."""
    pages = records.select(
        "raw_record_id", F.explode(F.col("source_pages").cast("array<bigint>")).alias("source_page")
    ).unionByName(
        attached.select("raw_record_id", F.col("source_page").cast("bigint").alias("source_page"))
    )
    if supporting is not None:
        section, reference = SUPPORTED_REFERENCE
        owners = records.filter((F.col("section") == section) & (F.col("reference_number") == reference))
        pages = pages.unionByName(
            owners.select("raw_record_id", "source_document")
            .join(supporting.select("source_document", "source_page"), "source_document")
            .select("raw_record_id", F.col("source_page").cast("bigint").alias("source_page"))
        )
    return pages.distinct()


def provision_snapshot(provisions: DataFrame, sources: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """Provisions stamped with the metadata of their source document, one row per structural mapping.

    mappings: (provision_id, corresponds_to), which part of the other regulations a provision answers to in structure; a
    provision without one has a null. Correspondence says nothing about single entries or versions.
    """
    stamped = provisions.join(
        sources.select(
            "source_document",
            F.col("document_revision").alias("source_version"),
            F.col("sha256").alias("source_hash"),
            "source_url", "effective_date", "retrieval_date",
        ),
        "source_document",
    )
    if mappings is None:
        return stamped.withColumn("corresponds_to", F.lit(None).cast("string"))
    return stamped.join(mappings.select("provision_id", "corresponds_to"), "provision_id", "left")


# --- catalogue ----------------------------------------------------------------------------------


def build_catalogue(glossary: DataFrame, id_prefix: str = "entry-", width: int = 5) -> DataFrame:
    """One identity per catalogue key. The lowest entry names it.

    Its source rows are in ``catalogue_sources``, one row each, so a name that fills a large part of
    the glossary is still one counted group.
    """
    keyed = X.catalogue_keys(glossary, "canonical_name", "search_name")
    return (
        keyed.groupBy("search_name")
        .agg(
            F.min("entry_number").alias("primary_entry"),
            F.min_by("canonical_name", "entry_number").alias("canonical_name"),
            F.count("*").alias("source_rows"),
            F.min("source_page").alias("first_page"),
            F.max("source_page").alias("last_page"),
        )
        .select(
            F.concat(F.lit(id_prefix), F.lpad(F.col("primary_entry").cast("string"), width, "0")).alias("ingredient_id"),
            "canonical_name", "search_name", "source_rows", "first_page", "last_page",
        )
    )


def catalogue_sources(glossary: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(ingredient_id, entry_number, source_page, raw_record_id) of every glossary row."""
    keyed = X.catalogue_keys(glossary, "canonical_name", "search_name")
    return keyed.join(catalogue.select("search_name", "ingredient_id"), "search_name").select(
        "ingredient_id", "entry_number", "source_page", "raw_record_id"
    )


def catalogue_key_collisions(glossary: DataFrame) -> DataFrame:
    """Keys with several spellings (an error) and keys with several rows (duplicates)."""
    keyed = X.catalogue_keys(glossary, "canonical_name", "search_name")
    groups = keyed.groupBy("search_name").agg(
        F.count("*").alias("source_rows"),
        (F.min("canonical_name") != F.max("canonical_name")).alias("_spellings"),
        F.min("entry_number").alias("first_entry"),
    )
    return groups.filter("source_rows > 1").select(
        "search_name", F.when(F.col("_spellings"), "different_names").otherwise("duplicate_rows").alias("kind"),
        "source_rows", "first_entry",
    )
