"""Ranked name search of many queries at once.

Exact and prefix hits are an equi-join of the beginnings of every key that have the length of some query. An entry is one row
with all of its keys, so it meets a query once and the best hits are cut within each task, before anything is shuffled.
Substring hits use an index of three-character grams, one row per gram of a key: a query meets only the keys that
hold its rarest gram, and is then looked up in them. Queries of two characters use grams of two. So rows per key
grow with its length, and nothing is compared pairwise. Only queries that still lack results are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import constants as K
from assayer.functions.text import derived_name, display_name, text_key, trimmed, value_keys
from assayer.session import materialize


def search_queries(queries: DataFrame, kind: str) -> DataFrame:
    """Distinct usable query keys; a query needs two characters."""
    usable = queries.filter(F.length(trimmed(F.col("query"))) >= 2)
    return value_keys(usable, {"query_key": "query"}, kind).select("query_key").filter("query_key <> ''").distinct()


def _with_lengths(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries with the query lengths in use that fit the key, as ``_lengths``.

    The lengths are one small scalar: at most as many as the longest query has characters.
    """
    lengths = keys.agg(F.collect_set(F.length("query_key"))).scalar()
    return entries.withColumn("_all", lengths).withColumn(
        "_lengths", F.filter("_all", lambda n: n <= F.length("key"))
    ).drop("_all")


def _prefixes(entries: DataFrame, keys: DataFrame) -> DataFrame:
    pieces = F.transform("_lengths", lambda n: F.substr("key", F.lit(1), n))
    return _with_lengths(entries, keys).withColumn("query_key", F.explode(pieces)).drop("_lengths")


def _beginnings(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries once per different beginning of their ``_keys`` that has the length of some query."""
    lengths = keys.agg(F.collect_set(F.length("query_key"))).scalar()
    pieces = F.transform(
        "_keys", lambda key: F.transform(F.filter("_all", lambda n: n <= F.length(key)), lambda n: F.substr(key, F.lit(1), n))
    )
    return entries.withColumn("_all", lengths).withColumn("query_key", F.explode(F.array_distinct(F.flatten(pieces)))).drop("_all")


GRAM = 3
#: Hits of one query that one task may order; an entry is a hit of a query once at most per key.
HITS_PER_TASK = 250_000
#: At most so many grams hold more than their part of all rows of the index.
HEAVY = 1000


def _grams(key: Column, size: Column) -> Column:
    """The distinct runs of ``size`` characters of a key."""
    at = F.when(F.length(key) >= size, F.sequence(F.lit(1), F.length(key) - size + 1))
    return F.array_distinct(F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.substr(key, i, size)))


def _candidates(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries that hold the rarest gram of a query, with ``query_key`` and ``_salt``.

    Grams are counted over all entries first. The rows of a heavy gram are dealt over several tasks by a salt, and its
    queries are copied once per salt; there are at most HEAVY such grams, so their table is broadcast.
    """
    short = F.least(F.length("query_key"), F.lit(GRAM))
    asked = keys.select("query_key", F.explode(_grams(F.col("query_key"), short)).alias("gram"))
    sizes = [F.lit(n) for n in (GRAM - 1, GRAM) if n == GRAM or not keys.filter(F.length("query_key") < GRAM).isEmpty()]
    grams = F.flatten(F.transform("_keys", lambda key: F.flatten(F.array(*(_grams(key, n) for n in sizes)))))
    index = entries.withColumn("gram", F.explode(F.array_distinct(grams)))
    wanted = asked.select("gram").distinct()
    counts = materialize(index.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
    part = max(HITS_PER_TASK, (counts.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    salts = F.ceil(F.col("n") / part).cast("int")
    rarest = asked.join(counts, "gram", "left").groupBy("query_key").agg(
        F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r")
    )
    # a gram that no entry holds leaves nothing to find; written, as its size is not guessed right: else the index was shuffled or sent to all
    dealt = materialize(
        rarest.select("query_key", "r.*").filter("n is not null").select(
            "query_key", "gram", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt")
        ),
        "dealt-queries",
    )
    heavy = F.broadcast(counts.filter(F.col("n") > part).select("gram", salts.alias("_parts")))
    salted = index.join(heavy, "gram", "left").withColumn(
        "_salt", F.pmod(F.xxhash64(entries.columns[0]), F.coalesce("_parts", F.lit(1))).cast("int")
    )
    found = salted.drop("_parts").join(dealt, ["gram", "_salt"]).drop("gram")
    return found.filter(F.exists("_keys", lambda key: F.contains(key, F.col("query_key"))))


def _salts(entries: DataFrame) -> int:
    """Parts into which the hits of a query are dealt, from the number of entries that could all be hits."""
    return max(1, -(-entries.count() // HITS_PER_TASK))


def _salted(keys: DataFrame, salts: int) -> DataFrame:
    """Query keys once per salt, so that a query with very many hits is spread over tasks."""
    return keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _top(hits: DataFrame, order: list[str], k: int) -> DataFrame:
    """First k rows per query: first per query and salt, then among those few."""
    part = Window.partitionBy("query_key", "_salt").orderBy(*order)
    few = hits.withColumn("_part", F.row_number().over(part)).filter(F.col("_part") <= k).drop("_part", "_salt")
    whole = Window.partitionBy("query_key").orderBy(*order)
    return few.withColumn("position", F.row_number().over(whole)).filter(F.col("position") <= k)


def ranked_hits(keys: DataFrame, entries: DataFrame, order: list[str], k: int) -> DataFrame:
    """Best k entries per query: exact before prefix before substring, then ``order``.

    ``entries`` has its id first and a ``key``; an entry with several keys counts with its best rank, and equal entries
    count once. Entries, queries and the first result are written between the steps: all are used several times,
    and their known size decides whether the pieces of the keys need a shuffle at all.
    """
    keys = materialize(keys, "search-queries")
    kept = [c for c in entries.columns if c != "key"]
    entries = materialize(entries.groupBy(*kept).agg(F.collect_set("key").alias("_keys")), "search-entries")
    salts = _salts(entries)
    salt = F.pmod(F.xxhash64(kept[0]), F.lit(salts)).cast("int")

    query = F.col("query_key")
    exact = F.array_contains("_keys", query)
    starts = F.exists("_keys", lambda key: F.startswith(key, query))

    def best(hits: DataFrame, rank) -> DataFrame:
        return _top(hits.select("query_key", "_salt", *kept, rank.alias("rank")), ["rank", *order], k)

    beginnings = _beginnings(entries.withColumn("_salt", salt), keys).join(_salted(keys, salts), ["query_key", "_salt"])
    top = materialize(best(beginnings, F.when(exact, 0).otherwise(1)), "prefix-hits")
    # queries that are already full need no substring step
    full = top.groupBy("query_key").agg(F.count("*").alias("_n")).filter(F.col("_n") >= k).select("query_key")
    open_keys = materialize(keys.join(full, "query_key", "left_anti"), "open-queries")
    rank = F.when(exact, 0).when(starts, 1).otherwise(2)
    return top.join(full, "query_key", "left_semi").unionByName(best(_candidates(entries, open_keys), rank))


def prefix_search(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All catalogue rows whose key starts with the query key."""
    keys = materialize(search_queries(queries, "catalogue"), "search-queries")
    entries = catalogue.select("ingredient_id", F.col("search_name").alias("key"))
    salts = _salts(entries)
    entries = entries.withColumn("_salt", F.pmod(F.xxhash64("ingredient_id"), F.lit(salts)).cast("int"))
    hits = _prefixes(entries, keys).join(_salted(keys, salts), ["query_key", "_salt"])
    return hits.select("query_key", F.col("key").alias("search_name"), "ingredient_id")


def ranked_catalogue_search(queries: DataFrame, catalogue: DataFrame, k: int = 20) -> DataFrame:
    keys = search_queries(queries, "catalogue")
    entries = catalogue.select("ingredient_id", "canonical_name", "search_name", F.col("search_name").alias("key"))
    hits = ranked_hits(keys, entries, ["search_name", "ingredient_id"], k)
    return hits.select(
        "query_key", "position", "rank", "ingredient_id", "search_name", display_name(F.col("canonical_name")).alias("display_name")
    )


def rule_keys(rules: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """Active rules of some sections with every search key of their name."""
    derived = derived_name(F.col("substance_name"))
    keyed = rules.filter(F.col("active") & F.col("regulatory_section").isin(*sections)).select(
        "rule_id",
        "regulatory_section",
        text_key(F.col("substance_name")).alias("_full"),
        F.when(derived.isNotNull(), text_key(derived)).alias("_short"),
    )
    keys = F.array_distinct(F.array_compact(F.array("_full", "_short")))
    return keyed.select("rule_id", "regulatory_section", F.array_min(keys).alias("first_key"), F.explode(keys).alias("key"))


def ranked_rule_search(queries: DataFrame, rules: DataFrame, sections: tuple[str, ...] = K.ADVISORY_SECTIONS, k: int = 20) -> DataFrame:
    keys = search_queries(queries, "regulatory")
    hits = ranked_hits(keys, rule_keys(rules, sections), ["first_key", "regulatory_section", "rule_id"], k)
    return hits.select("query_key", "position", "rank", "rule_id", "regulatory_section", "first_key")


def combined_search(queries: DataFrame, catalogue: DataFrame, rules: DataFrame, both: bool = True) -> DataFrame:
    """Catalogue and advisory hits side by side, with equal quotas when both sources are on."""
    quota = 10 if both else 20
    names = ranked_catalogue_search(queries, catalogue, quota).select(
        "query_key", F.lit("eu").alias("source"), "position", "rank", F.col("ingredient_id").alias("item")
    )
    if not both:
        return names
    entries = ranked_rule_search(queries, rules, K.ADVISORY_SECTIONS, quota).select(
        "query_key", F.lit("acd").alias("source"), "position", "rank", F.col("rule_id").alias("item")
    )
    return names.unionByName(entries)
