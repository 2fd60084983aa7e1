"""Joinable views of the accepted snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import constants as K
from assayer.functions.text import derived_name, identifier_checksum, text_key
from assayer.operators.ordering import numbered

METHODS = {"name": "exact_name", "derived": "derived_source_name_except_clause", "cas": "exact_cas"}


def substance_lookup(substances: DataFrame) -> DataFrame:
    """(key_type, key, method, substance_id, advisory) of active substances.

    key_type is ``name`` for the full and the derived name, ``cas`` for valid registry numbers.
    """
    active = substances.filter("active").select(
        "substance_id",
        F.col("regulatory_section").isin(*K.ADVISORY_SECTIONS).alias("advisory"),
        text_key(F.col("original_substance_name")).alias("_name"),
        F.when(
            derived_name(F.col("original_substance_name")).isNotNull(),
            text_key(derived_name(F.col("original_substance_name"))),
        ).alias("_derived"),
        F.filter("cas_numbers", identifier_checksum).alias("_cas"),
    )

    def entry(key_type: str, method: str, key):
        return F.struct(F.lit(key_type).alias("key_type"), F.lit(METHODS[method]).alias("method"), key.alias("key"))

    entries = F.concat(
        F.array(entry("name", "name", F.col("_name"))),
        F.when(F.col("_derived").isNotNull(), F.array(entry("name", "derived", F.col("_derived")))).otherwise(
            F.array().cast("array<struct<key_type:string,method:string,key:string>>")
        ),
        F.transform("_cas", lambda c: entry("cas", "cas", c)),
    )
    return active.select("substance_id", "advisory", F.explode(entries).alias("e")).select(
        "e.key_type", "e.key", "e.method", "substance_id", "advisory"
    )


def rule_subsets(rules: DataFrame) -> DataFrame:
    """Controlling rules tagged executable, inactive or withheld."""
    controlling = rules.filter(F.col("regulatory_section").isin(*K.CONTROLLING_SECTIONS) & F.col("substance_id").isNotNull())
    subset = (
        F.when(F.col("active") & (F.col("normalization_status") == "normalized"), "executable")
        .when(~F.col("active") | (F.col("normalization_status") == "inactive_source_entry"), "inactive")
        .otherwise("withheld")
    )
    return controlling.withColumn("subset", subset)


def subset_counts(rules: DataFrame) -> DataFrame:
    return (
        rule_subsets(rules)
        .groupBy("substance_id")
        .agg(
            F.count_if(F.col("subset") == "executable").alias("executable_rules"),
            F.count_if(F.col("subset") == "inactive").alias("inactive_rules"),
            F.count("*").alias("rules"),
        )
    )


def rules_by_reference(rules: DataFrame) -> DataFrame:
    """Controlling rules addressed by (section, reference), one row per rule."""
    return rules.filter(F.col("regulatory_section").isin(*K.CONTROLLING_SECTIONS)).select(
        "regulatory_section", F.lower("reference_number").alias("reference_key"), "rule_id", "raw_record_id", "active"
    )


def product_contexts(rules: DataFrame) -> DataFrame:
    """Distinct context keys of controlling rules with the first spelling in rule order."""
    return (
        rules.filter(
            F.col("regulatory_section").isin(*K.CONTROLLING_SECTIONS)
            & (F.coalesce("product_context", F.lit("")) != "")
        )
        .groupBy("product_context")
        .agg(F.min("rule_id").alias("_rule"))
        .withColumn("context_key", text_key(F.col("product_context")))
        .groupBy("context_key")
        .agg(F.min_by("product_context", "_rule").alias("product_context"))
    )


def context_options(contexts: DataFrame) -> DataFrame:
    """Contexts numbered in case-insensitive order, as they are offered for selection."""
    found = numbered(contexts, [], [F.lower("product_context"), "product_context"], "option_index")
    return found.withColumn("option_index", F.col("option_index").cast("int"))
