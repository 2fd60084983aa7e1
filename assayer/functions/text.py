"""Text keys and text parsers as Column expressions.

There are three text keys and they differ on purpose:

* regulatory key: NFKC, casefold, U+FFFD dropped, dashes folded to ``-``, whitespace collapsed;
* catalogue key: NFKC, casefold, whitespace collapsed (no dash folding);
* grid key: whitespace collapsed, casefold (no NFKC).

For ASCII values all of them are built-in string functions. Only values with other characters go
through one Arrow UDF; ASCII rows reach Python as nulls.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer import constants as K
from assayer.session import materialize

_SPACES = r"[\t-\r\x1c-\x20]+"
_NON_ASCII = r"[^\x00-\x7F]"


def _fold_udf(kind: str):
    """Arrow UDF of one key. All helpers are local, so executors need no copy of this package."""

    @F.pandas_udf(T.StringType())
    def folded(values: pd.Series) -> pd.Series:
        import unicodedata

        dashes = dict.fromkeys(map(ord, "‐‑‒–—−"), "-")

        def fold(value: str) -> str:
            if kind != "grid":
                value = unicodedata.normalize("NFKC", value)
            value = value.casefold()
            if kind == "regulatory":
                value = value.replace("\ufffd", "").translate(dashes)
            return " ".join(value.split())

        return values.map(fold, na_action="ignore")

    return folded


def native_key(value: Column) -> Column:
    """The key of an ASCII value; identical for all three kinds."""
    return F.btrim(F.lower(F.regexp_replace(value, _SPACES, " ")))


def text_key(value: Column, kind: str = "regulatory") -> Column:
    """Key of any value; null gives ''."""
    special = value.rlike(_NON_ASCII)
    folded = _fold_udf(kind)(F.when(special, value))
    return F.coalesce(F.when(special, folded).otherwise(native_key(value)), F.lit(""))


def key_for(kind: str, *values: tuple[DataFrame, Column]):
    """``text_key`` for columns that hold ``values``: the built-in key alone if all of them are ASCII, so no row meets Python."""
    if any(not df.filter(F.coalesce(column.rlike(_NON_ASCII), F.lit(False))).isEmpty() for df, column in values):
        return lambda value: text_key(value, kind)
    return lambda value: F.coalesce(native_key(value), F.lit(""))


def _keyed(df: DataFrame, column: str, out: str, kind: str) -> DataFrame:
    """``df`` with the key of a column. Each distinct value with other characters meets Python once; without any, none does."""
    special = F.col(column).rlike(_NON_ASCII)
    native = F.coalesce(native_key(F.col(column)), F.lit(""))
    values = df.filter(special).select(F.col(column).alias("_value")).distinct()
    if values.isEmpty():
        return df.withColumn(out, native)
    values = materialize(values.withColumn("_key", F.coalesce(_fold_udf(kind)("_value"), F.lit(""))), "folded-values")
    plain = df.filter(~F.coalesce(special, F.lit(False))).withColumn(out, native)
    others = df.filter(special).join(values, F.col(column) == F.col("_value")).withColumn(out, F.col("_key"))
    return plain.unionByName(others.select(*plain.columns))


def normalize_names(df: DataFrame, column: str, out: str) -> DataFrame:
    return _keyed(df, column, out, "regulatory")


def catalogue_keys(df: DataFrame, column: str, out: str) -> DataFrame:
    return _keyed(df, column, out, "catalogue")


def grid_keys(df: DataFrame, column: str, out: str) -> DataFrame:
    return _keyed(df, column, out, "grid")


def value_keys(df: DataFrame, columns: dict[str, str], kind: str = "regulatory") -> DataFrame:
    """``df`` with the keys of several columns, by output name. Without other than ASCII characters no row meets Python."""
    special = [F.coalesce(F.col(c).rlike(_NON_ASCII), F.lit(False)) for c in columns.values()]
    if not df.filter(reduce(or_, special)).isEmpty():
        for out, column in columns.items():
            df = _keyed(df, column, out, kind)
        return df
    return df.withColumns({out: F.coalesce(native_key(F.col(column)), F.lit("")) for out, column in columns.items()})


def present(value: Column) -> Column:
    """Non-null and not blank."""
    return F.coalesce(~value.rlike(K.BLANK), F.lit(False))


def absent_apart(key: Column, *others: Column) -> Column:
    """A join key whose absent values ('' or null) are told apart by other columns.

    Absent keys match nothing, but they would all be sent to one task. With a leading NUL they still
    match nothing and are spread over all tasks.
    """
    apart = F.concat(F.lit("\x00"), F.concat_ws("\x00", *[o.cast("string") for o in others]))
    return F.when(F.coalesce(key, F.lit("")) != "", key).otherwise(apart)


def slug(value: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), F.lit("-"))


def slug_ids(records: DataFrame) -> DataFrame:
    """Rule and substance ids from the section's prefix and the reference."""
    prefix = F.create_map(*[F.lit(x) for pair in K.RULE_ID_PREFIXES.items() for x in pair])
    rule_id = F.concat_ws("-", F.element_at(prefix, F.col("section")), slug(F.col("reference_number")))
    return records.withColumn("base_rule_id", rule_id).withColumn(
        "base_substance_id", F.concat(F.lit("substance-"), rule_id)
    )


# --- registry numbers ---------------------------------------------------------------------------


def identifier_checksum(value: Column) -> Column:
    """True for three all-digit parts whose weighted digit sum modulo 10 equals the third part."""
    parts = F.split(value, "-")
    body = F.reverse(F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(body)),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc + F.substr(body, i, F.lit(1)).cast("bigint") * i,
    )
    shaped = value.rlike(r"^[0-9]+-[0-9]+-[0-9]+$")
    return F.coalesce(
        F.when(shaped, total % 10 == F.get(parts, F.lit(2)).try_cast("bigint")), F.lit(False)
    )


def is_structured_identifier(value: Column) -> Column:
    """As ``identifier_checksum`` for values of the structure, which have ten digits at most: one number, without arrays."""
    digits = F.replace(value, F.lit("-"), F.lit("")).try_cast("bigint")
    total = reduce(add, [F.floor(digits / 10**i) % 10 * i for i in range(1, 10)])
    return F.when(value.rlike(K.IDENTIFIER_STRUCTURE), F.coalesce(total % 10 == digits % 10, F.lit(False))).otherwise(False)


def harvested_identifiers(value: Column) -> tuple[Column, Column]:
    """(valid, malformed) registry numbers in a text, each distinct and sorted."""
    tokens = F.array_sort(
        F.array_distinct(
            F.transform(
                F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(K.IDENTIFIER_PATTERN), F.lit(0)),
                lambda t: F.regexp_replace(t, r"(?U)\s+", ""),
            )
        )
    )
    return F.filter(tokens, is_structured_identifier), F.filter(tokens, lambda t: ~is_structured_identifier(t))


def harvest_identifiers(df: DataFrame, column: str) -> DataFrame:
    valid, malformed = harvested_identifiers(F.col(column))
    return df.withColumn("cas_numbers", valid).withColumn("malformed_identifiers", malformed)


# --- limits -------------------------------------------------------------------------------------

LIMIT_TYPE = (
    "struct<value:double,unit:string,comparator:string,basis:string,"
    "preparation_stage:string,source_field:string,source_text:string>"
)


def limit_hits(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(K.LIMIT_PATTERN), F.lit(0))


def parse_limit(text: Column, folded: Column, source_field: str, default_stage: Column | str) -> Column:
    """Exactly one number with a unit becomes a limit; anything else is null.

    ``folded`` is the regulatory key of ``text``.
    """
    stage = F.lit(default_stage) if isinstance(default_stage, str) else default_stage
    number = F.regexp_extract(text, K.LIMIT_PATTERN, 1).try_cast("double")
    unit = F.lower(F.regexp_replace(F.regexp_extract(text, K.LIMIT_PATTERN, 2), r"(?U)\s+", ""))
    or_equal = folded.contains("or equal")
    basis = F.regexp_extract(text, K.BASIS_PATTERN, 1)
    bracket = F.regexp_extract(text, K.BASIS_BRACKET_PATTERN, 1)
    limit = F.struct(
        number.alias("value"),
        F.when(unit == "%", "percent").otherwise(unit).alias("unit"),
        F.when(folded.contains("less than") & ~or_equal, "less_than")
        .when(folded.contains("greater than") & ~or_equal, "greater_than")
        .otherwise("less_than_or_equal")
        .alias("comparator"),
        F.when(basis != "", F.btrim(basis)).when(bracket != "", F.btrim(bracket)).alias("basis"),
        F.when(folded.contains("after mixing"), "after_mixing")
        .when(folded.contains("ready for use"), "ready_for_use")
        .when(folded.contains("finished product"), "finished_product")
        .when(folded.contains("ingredient") | folded.contains("impurit"), "ingredient")
        .otherwise(stage)
        .alias("preparation_stage"),
        F.lit(source_field).alias("source_field"),
        text.alias("source_text"),
    )
    return F.when(F.size(limit_hits(text)) == 1, limit)


def parse_limits(
    df: DataFrame, column: str, source_field: str, default_stage: Column | str, out: str = "concentration"
) -> DataFrame:
    folded = df.withColumn("_folded", text_key(F.col(column)))
    return folded.withColumn(
        out, parse_limit(F.col(column), F.col("_folded"), source_field, default_stage)
    ).drop("_folded")


# --- lettered cases -----------------------------------------------------------------------------


def case_labels(text: Column) -> Column:
    """Labels of every lettered marker at a line start, in order, lower case."""
    value = F.coalesce(text, F.lit(""))
    return F.transform(
        F.regexp_extract_all(value, F.lit(K.CASE_PATTERN), F.lit(0)),
        lambda marker: F.lower(F.regexp_extract(marker, "([A-Za-z])", 1)),
    )


def case_map(text: Column) -> Column:
    """label -> text; null when there are no two cases, text precedes them, or a label repeats."""
    value = F.coalesce(text, F.lit(""))
    labels = case_labels(text)
    pieces = F.split(value, K.CASE_PATTERN)
    usable = (
        (F.size(labels) >= 2)
        & (F.btrim(F.regexp_replace(F.get(pieces, F.lit(0)), r"(?U)\s+", " ")) == "")
        & (F.size(F.array_distinct(labels)) == F.size(labels))
    )
    bodies = F.transform(F.slice(pieces, 2, F.size(labels)), lambda p: trimmed(p))
    return F.when(usable, F.map_from_arrays(labels, bodies))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, rf"\A[{K.WHITESPACE}]++|[{K.WHITESPACE}]++\z", "")


def split_cases(df: DataFrame, column: str, out: str = "cases") -> DataFrame:
    return df.withColumn(out, case_map(F.col(column)))


def aligned_labels(maps: dict[str, Column]) -> Column:
    """Labels shared by all labelled fields, or null.

    The first labelled field must count a, b, c ...; the others must carry the same list; and both
    the context and the limit text must be labelled.
    """
    label_lists = {name: F.map_keys(value) for name, value in maps.items()}
    first = F.coalesce(*label_lists.values())
    expected = F.transform(F.sequence(F.lit(0), F.size(first) - 1), lambda i: F.char(i + F.ascii(F.lit("a"))))
    same = F.lit(True)
    for labels in label_lists.values():
        same = same & (labels.isNull() | (labels == first))
    usable = (
        first.isNotNull()
        & (first == expected)
        & same
        & maps["product_context"].isNotNull()
        & maps["concentration_text"].isNotNull()
    )
    return F.when(usable, first)


def align_case_maps(df: DataFrame, columns: dict[str, str], out: str = "labels") -> DataFrame:
    """``columns`` maps each logical field to the column holding its case map."""
    return df.withColumn(out, aligned_labels({name: F.col(column) for name, column in columns.items()}))


# --- wording flags ------------------------------------------------------------------------------


def any_phrase(folded: Column, phrases: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | folded.contains(phrase)
    return hit


def conditional_wording_flags(df: DataFrame, column: str) -> DataFrame:
    keyed = df.withColumn("_folded", text_key(F.col(column)))
    return (
        keyed.withColumn("conditional_wording", any_phrase(F.col("_folded"), K.CONDITIONAL_PHRASES))
        .withColumn("non_exhaustive_scope", F.col("_folded").contains(K.NON_EXHAUSTIVE_PHRASE))
        .drop("_folded")
    )


def has_secondary_limit(text: Column) -> Column:
    return F.coalesce(text.rlike(K.SECONDARY_LIMIT_PATTERN), F.lit(False))


def secondary_numeric_flags(df: DataFrame, column: str, out: str = "secondary_numeric") -> DataFrame:
    return df.withColumn(out, has_secondary_limit(F.col(column)))


def is_active_entry(folded_name: Column, reference: Column) -> Column:
    return (
        (folded_name != "")
        & ~F.coalesce(reference.rlike(K.RANGE_PATTERN), F.lit(False))
        & ~folded_name.isin(*K.INACTIVE_NAMES)
        & ~folded_name.startswith(K.INACTIVE_NAME_START)
    )


def inactive_entries(records: DataFrame) -> DataFrame:
    keyed = records.withColumn("_folded", text_key(F.col("original_substance_name")))
    return keyed.withColumn("active", is_active_entry(F.col("_folded"), F.col("reference_number"))).drop("_folded")


# --- search names -------------------------------------------------------------------------------


def derived_name(name: Column) -> Column:
    """Text before the first `` (except ``, or null when there is none or it is blank."""
    at = F.instr(F.lower(name), " (except ")
    prefix = trimmed(F.substr(name, F.lit(1), at - 1))
    return F.when((at > 1) & (prefix != ""), prefix)


def derived_search_names(substances: DataFrame, name: str = "original_substance_name") -> DataFrame:
    """(substance_id, key): the full-name key, plus the derived key when it differs."""
    keyed = substances.select(
        "substance_id",
        text_key(F.col(name)).alias("_full"),
        F.when(derived_name(F.col(name)).isNotNull(), text_key(derived_name(F.col(name)))).alias("_derived"),
    )
    keys = F.array_distinct(F.array_compact(F.array("_full", "_derived")))
    return keyed.select("substance_id", F.explode(keys).alias("key"))


def display_name(name: Column) -> Column:
    """All-capitals ASCII words read better as a capitalised phrase."""
    shown = F.concat(F.substr(name, F.lit(1), F.lit(1)), F.lower(F.substr(name, F.lit(2))))
    return F.when(name.rlike("^[A-Z]+(?: [A-Z]+)*$"), shown).otherwise(name)


# --- upload cells -------------------------------------------------------------------------------


def unit_code(value: Column) -> Column:
    return _synonym(F.replace(F.lower(trimmed(value)), F.lit(" "), F.lit("")), K.UNIT_SYNONYMS)


def stage_code(value: Column) -> Column:
    return _synonym(F.regexp_replace(F.lower(trimmed(value)), r"(?U)[\s-]+", "_"), K.STAGE_SYNONYMS)


def _synonym(key: Column, synonyms: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.element_at(table, key)


def normalize_vocab(df: DataFrame, column: str, vocabulary: str, out: str = "code") -> DataFrame:
    code = {"unit": unit_code, "stage": stage_code}[vocabulary]
    return df.withColumn(out, code(F.col(column)))


_AMOUNT = r"(?iU)^\s*((?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))\s*(%|ppm|mg\s*/\s*kg)\s*$"
_BARE = r"(?U)^\s*(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*$"


def cell_amount(value: Column) -> tuple[Column, Column, Column]:
    """(amount, unit, state) of an amount cell; state is with_unit, bare, unavailable, none."""
    with_unit = F.coalesce(value.rlike(_AMOUNT), F.lit(False))
    bare = F.coalesce(value.rlike(_BARE), F.lit(False))
    token = F.lower(F.regexp_replace(F.regexp_extract(value, _AMOUNT, 2), r"(?U)\s+", ""))
    amount = F.when(with_unit, F.regexp_extract(value, _AMOUNT, 1).try_cast("double")).when(
        bare, trimmed(value).try_cast("double")
    )
    unit = F.when(with_unit, F.when(token == "%", "percent").otherwise(token))
    state = (
        F.when(with_unit, "with_unit")
        .when(bare, "bare")
        .when(F.lower(trimmed(value)).isin(*K.UNAVAILABLE_AMOUNTS), "unavailable")
        .otherwise("none")
    )
    return amount, unit, state


def parse_cell_amounts(cells: DataFrame, column: str = "source_value") -> DataFrame:
    amount, unit, state = cell_amount(F.col(column))
    return cells.withColumn("amount", amount).withColumn("unit", unit).withColumn("amount_state", state)
