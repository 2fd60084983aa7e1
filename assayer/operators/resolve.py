"""Identity resolution of submitted ingredients by exact name and registry number.

Submissions repeat: a handful of names make up a large share of all rows. Everything here therefore
works on distinct requests; the fact table meets the answer once, in ``screen``. Candidate sets are
stored per key, never per submitted row, and are compared through counts and minima instead of
pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import absent_apart, identifier_checksum, value_keys
from assayer.session import settle

REQUEST_COLUMNS = ("name", "cas_number", "product_context", "unit", "basis", "preparation_stage")
DIRECT_SOURCE = "singapore_regulatory_source"
ADVISORY_SOURCE = "acd_regulatory_source"
CATALOGUE_SOURCE = "ingredient_identity_catalogue"


def identity_requests(ingredients: DataFrame) -> DataFrame:
    """Distinct (name, registry number) with their keys; '' stands for absent."""
    distinct = ingredients.select("name", "cas_number").distinct()
    keyed = value_keys(value_keys(distinct, {"name_key": "name"}), {"catalogue_key": "name"}, "catalogue")
    return keyed.select(
        "name",
        "cas_number",
        "name_key",
        "catalogue_key",
        F.coalesce(F.regexp_replace("cas_number", r"(?U)^\s+|\s+$", ""), F.lit("")).alias("cas"),
    ).withColumn("cas_valid", (F.col("cas") != "") & identifier_checksum(F.col("cas")))


def match_by_name(requests: DataFrame, lookup: DataFrame) -> DataFrame:
    """Submitted name keys that equal a full or derived substance name."""
    keys = requests.filter("name_key <> ''").select(F.col("name_key").alias("key")).distinct()
    return keys.join(lookup.filter("key_type = 'name'"), "key")


def match_by_identifier(requests: DataFrame, lookup: DataFrame) -> DataFrame:
    """Submitted registry numbers with a right check digit that equal a substance's number."""
    keys = requests.filter("cas_valid").select(F.col("cas").alias("key")).distinct()
    return keys.join(lookup.filter("key_type = 'cas'"), "key")


def bridge_matches(matches: DataFrame, bridge: DataFrame) -> DataFrame:
    """Direct controlling matches and those reached from an advisory match."""
    direct = matches.filter("not advisory").select(
        "key_type", "key", "substance_id", "method", F.lit(None).cast("string").alias("status"), F.lit(True).alias("direct")
    )
    via = (
        matches.filter("advisory")
        .join(bridge, F.col("substance_id") == F.col("advisory_substance_id"))
        .select(
            "key_type",
            "key",
            F.col("controlling_substance_id").alias("substance_id"),
            F.concat("method", F.lit("_via_acd")).alias("method"),
            F.col("comparison_status").alias("status"),
            F.lit(False).alias("direct"),
        )
    )
    return direct.unionByName(via)


def merge_candidates(bridged: DataFrame) -> DataFrame:
    """One candidate per (key, substance); its method and status sets have few possible values."""
    return bridged.groupBy("key_type", "key", "substance_id").agg(
        F.array_sort(F.collect_set("method")).alias("match_methods"),
        F.array_sort(F.collect_set("status")).alias("cross_reference_statuses"),
        F.bool_or("direct").alias("direct"),
    )


def candidate_summary(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Per key: number of controlling candidates, the single one if there is one, advisory presence."""
    controlling = candidates.groupBy("key_type", "key").agg(
        F.count("*").alias("candidates"),
        F.min("substance_id").alias("substance_id"),
        F.bool_or("direct").alias("direct"),
        # sets over a fixed vocabulary of methods and statuses
        F.collect_set("match_methods").alias("_methods"),
        F.collect_set("cross_reference_statuses").alias("_statuses"),
    )
    advisory = matches.filter("advisory").select("key_type", "key").distinct().withColumn("advisory", F.lit(True))
    joined = controlling.join(advisory, ["key_type", "key"], "full_outer")
    empty = F.array().cast("array<array<string>>")
    return joined.select(
        "key_type",
        "key",
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        "substance_id",
        F.coalesce("direct", F.lit(False)).alias("direct"),
        F.array_sort(F.array_distinct(F.flatten(F.coalesce("_methods", empty)))).alias("methods"),
        F.array_sort(F.array_distinct(F.flatten(F.coalesce("_statuses", empty)))).alias("statuses"),
        F.coalesce("advisory", F.lit(False)).alias("advisory"),
    )


def common_candidates(requests: DataFrame, summary: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates shared by a request's name and number.

    The smaller of the two candidate sets is looked up in the larger one, so a name shared by a
    large part of the snapshot is never expanded against the numbers submitted with it.
    """
    sizes = summary.select("key_type", "key", "candidates")
    both = (
        requests.filter("name_key <> '' and cas_valid")
        .select("name_key", "cas")
        .distinct()
        .join(_of(sizes, "name", "name_key", "n_"), "name_key")
        .join(_of(sizes, "cas", "cas", "c_"), "cas")
        .filter("n_candidates > 0 and c_candidates > 0")
    )
    name_first = F.col("n_candidates") <= F.col("c_candidates")
    probes = both.select(
        "name_key",
        "cas",
        F.when(name_first, "name").otherwise("cas").alias("key_type"),
        F.when(name_first, F.col("name_key")).otherwise(F.col("cas")).alias("key"),
        F.when(name_first, "cas").otherwise("name").alias("other_type"),
        F.when(name_first, F.col("cas")).otherwise(F.col("name_key")).alias("other_key"),
    )
    small = probes.join(candidates.select("key_type", "key", "substance_id", "direct"), ["key_type", "key"])
    other = candidates.select(
        F.col("key_type").alias("other_type"),
        F.col("key").alias("other_key"),
        "substance_id",
        F.col("direct").alias("other_direct"),
    )
    return (
        small.join(other, ["other_type", "other_key", "substance_id"])
        .groupBy("name_key", "cas")
        .agg(
            F.count("*").alias("common"),
            F.min("substance_id").alias("common_id"),
            F.bool_or(F.col("direct") | F.col("other_direct")).alias("common_direct"),
        )
    )


def _of(summary: DataFrame, key_type: str, key: str, prefix: str) -> DataFrame:
    kept = summary.filter(F.col("key_type") == key_type).drop("key_type")
    return kept.select(F.col("key").alias(key), *[F.col(c).alias(prefix + c) for c in kept.columns if c != "key"])


def resolve_identity(requests: DataFrame, summary: DataFrame, common: DataFrame) -> DataFrame:
    """The decision table over names and numbers, one row per request."""
    keyed = requests.withColumn("_name_join", absent_apart(F.col("name_key"), F.col("cas"))).withColumn(
        "_cas_join", absent_apart(F.when(F.col("cas_valid"), F.col("cas")), F.col("name_key"), F.col("cas"))
    )
    df = (
        keyed.join(_of(summary, "name", "_name_join", "n_"), "_name_join", "left")
        .join(_of(summary, "cas", "_cas_join", "c_"), "_cas_join", "left")
        .join(common, ["name_key", "cas"], "left")
    )
    has_name, has_cas = F.col("name_key") != "", F.col("cas") != ""
    count = {p: F.coalesce(F.when(has, F.col(f"{p}_candidates")), F.lit(0)) for p, has in (("n", has_name), ("c", F.col("cas_valid")))}
    advisory = {p: F.coalesce(F.when(has, F.col(f"{p}_advisory")), F.lit(False)) for p, has in (("n", has_name), ("c", F.col("cas_valid")))}
    common_n = F.coalesce("common", F.lit(0))
    two = has_name & has_cas

    def one_key(column: str) -> Column:
        return F.when(has_name, F.col(f"n_{column}")).when(F.col("cas_valid"), F.col(f"c_{column}"))

    single_count = F.coalesce(one_key("candidates"), F.lit(0))
    single_advisory = F.coalesce(one_key("advisory"), F.lit(False))
    statuses = one_key("statuses")
    safe = one_key("direct") | (F.size(statuses) == 0) | (statuses == F.array(F.lit("aligned")))

    branch = (
        F.when(
            two,
            F.when((count["n"] == 0) & (count["c"] == 0) & ~advisory["n"] & ~advisory["c"], "nothing")
            .when(common_n == 1, "agreed")
            .when((count["n"] > 0) & (count["c"] > 0) & (common_n == 0), "different")
            .when(common_n > 1, "several_common")
            .when((count["n"] > 0) | (count["c"] > 0), "one_sided")
            .otherwise("advisory_pair"),
        )
        .when((single_count == 1) & safe, "single")
        .when(single_count == 1, "unsafe_bridge")
        .when(single_count > 1, "several")
        .when(single_advisory, "advisory_only")
        .otherwise("no_match")
    )
    df = df.withColumn("_branch", branch)
    b = F.col("_branch")
    status = (
        F.when(b.isin("agreed", "single"), "resolved")
        .when(b.isin("nothing", "no_match"), "unresolved")
        .when(b.isin("different", "several_common", "several"), "ambiguous")
        .otherwise("review_required")
    )
    reason_of = {
        "nothing": "neither_name_nor_cas_resolved_to_a_source_backed_identity",
        "different": "supplied_name_and_cas_resolve_to_different_singapore_identities",
        "several_common": "supplied_name_and_cas_have_multiple_common_singapore_identities",
        "one_sided": "only_one_supplied_identifier_provides_a_unique_corroborated_identity",
        "advisory_pair": "supplied_identifiers_do_not_establish_a_unique_singapore_identity",
        "unsafe_bridge": "singapore_identity_bridge_is_not_aligned",
        "several": "identifier_matches_multiple_singapore_identities",
        "advisory_only": "exact_identity_exists_only_in_the_acd_snapshot",
        "no_match": "no_source_backed_identity_match",
    }
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in reason_of.items() for x in pair]), b)
    malformed = has_cas & ~F.col("cas_valid") & (status != "resolved")
    union = F.array_sort(
        F.array_distinct(
            F.flatten(F.array_compact(F.array(F.when(has_name, F.col("n_methods")), F.when(F.col("cas_valid"), F.col("c_methods")))))
        )
    )
    methods = F.when(b == "agreed", union).when(b == "single", one_key("methods"))
    direct = F.when(b == "agreed", F.col("common_direct")).when(b == "single", one_key("direct"))
    return df.select(
        "name",
        "cas_number",
        "name_key",
        "catalogue_key",
        "cas",
        status.alias("status"),
        F.when(b == "agreed", F.col("common_id")).when(b == "single", one_key("substance_id")).alias("substance_id"),
        F.coalesce(methods, F.array().cast("array<string>")).alias("match_methods"),
        resolution_source(direct, ~two & (status != "resolved") & single_advisory).alias("identity_source_type"),
        F.array_compact(F.array(F.when(malformed, "supplied_cas_is_malformed"), reason)).alias("reasons"),
        (count["n"] + count["c"] - common_n).alias("controlling_candidates"),
        (advisory["n"] | advisory["c"]).alias("has_advisory_candidate"),
    )


def resolution_source(direct: Column, advisory_open: Column) -> Column:
    """Controlling source if the winner was matched directly, advisory if only through the bridge."""
    return F.when(direct, DIRECT_SOURCE).when(~direct, ADVISORY_SOURCE).when(advisory_open, ADVISORY_SOURCE)


def catalogue_fallback(resolved: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Unresolved names that equal a catalogue name.

    The catalogue has no registry numbers, so a number given with the name leaves a review.
    """
    known = catalogue.select(
        F.col("search_name").alias("_name_join"), "ingredient_id", F.col("canonical_name").alias("catalogue_name")
    )
    keyed = resolved.withColumn("_name_join", absent_apart(F.col("catalogue_key"), F.col("cas")))
    joined = keyed.join(known, "_name_join", "left")
    hit = (F.col("status") == "unresolved") & (F.col("name_key") != "") & F.col("ingredient_id").isNotNull()
    numbered = F.col("cas") != ""
    return joined.select(
        "name",
        "cas_number",
        "name_key",
        "cas",
        F.when(hit, F.when(numbered, "review_required").otherwise("resolved")).otherwise(F.col("status")).alias("status"),
        "substance_id",
        F.when(hit, F.array(F.lit("exact_catalogue_name"))).otherwise(F.col("match_methods")).alias("match_methods"),
        F.when(hit, CATALOGUE_SOURCE).otherwise(F.col("identity_source_type")).alias("identity_source_type"),
        F.when(
            hit,
            F.when(numbered, F.array(F.lit("supplied_cas_cannot_be_corroborated_by_catalogue_source"))).otherwise(
                F.array().cast("array<string>")
            ),
        )
        .otherwise(F.col("reasons"))
        .alias("reasons"),
        F.when(hit, F.col("ingredient_id")).alias("catalogue_ingredient_id"),
        F.when(hit, F.col("catalogue_name")).alias("catalogue_name"),
        "controlling_candidates",
        "has_advisory_candidate",
    )


def degraded_catalogue(resolved: DataFrame, error: str | None) -> DataFrame:
    """Resolution while the catalogue cannot be used; with an error, unresolved names wait for review."""
    withheld = (F.col("status") == "unresolved") & (F.col("name_key") != "") & F.lit(bool(error))
    return resolved.select(
        "name",
        "cas_number",
        "name_key",
        "cas",
        F.when(withheld, "review_required").otherwise(F.col("status")).alias("status"),
        "substance_id",
        "match_methods",
        "identity_source_type",
        F.when(withheld, F.array(F.lit("ingredient_catalogue_unavailable_identity_verification_withheld")))
        .otherwise(F.col("reasons"))
        .alias("reasons"),
        F.lit(None).cast("string").alias("catalogue_ingredient_id"),
        F.lit(None).cast("string").alias("catalogue_name"),
        "controlling_candidates",
        "has_advisory_candidate",
    )


def candidates_for(requests: DataFrame, lookup: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates) of the submitted keys only."""
    matches = match_by_name(requests, lookup).unionByName(match_by_identifier(requests, lookup))
    return matches, merge_candidates(bridge_matches(matches, bridge))


def resolve(
    requests: DataFrame,
    lookup: DataFrame,
    bridge: DataFrame,
    catalogue: DataFrame | None,
    catalogue_error: str | None = None,
) -> DataFrame:
    """Full resolution of distinct requests.

    The key-level tables are written between the steps; all of them are as small as the number of
    distinct submitted keys.
    """
    requests = settle(requests, "identity-requests")
    matches = settle(
        match_by_name(requests, lookup).unionByName(match_by_identifier(requests, lookup)), "matches"
    )
    candidates = settle(merge_candidates(bridge_matches(matches, bridge)), "candidates")
    summary = settle(candidate_summary(candidates, matches), "candidate-summary")
    resolved = resolve_identity(requests, summary, common_candidates(requests, summary, candidates))
    if catalogue is None:
        resolved = degraded_catalogue(resolved, catalogue_error)
    else:
        resolved = catalogue_fallback(resolved, catalogue)
    return settle(resolved, "resolved")
