"""Registered queries of text jobs, rule normalisation and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import text as X
from assayer.operators import rules as R
from assayer.plans.adapters import ENTITIES, entity, oracle, table
from assayer.plans.oracle_parts import cas_ok, fold

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def pipe(column):
    return F.array_join(column, "|")


def records(spark, d):
    return entity(spark, d, "records")


# --- oracle parts ---------------------------------------------------------------------------------

_LIMIT = "(?i)([0-9]+(?:\\.[0-9]+)?)\\s*(%|mg\\s*/\\s*kg|ppm)"
_CASE = "(?im)^\\s*\\(?([a-z])\\)\\s*"
_FIELDS = {
    "c": "original_field_of_use_text", "l": "original_concentration_text",
    "o": "original_conditions_text", "w": "original_warning_text",
}


def _labels(column: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({column}, ''), '{_CASE}', 1), lambda x: lower(x))"


def _map(column: str) -> str:
    pieces = f"string_split_regex(coalesce({column}, ''), '{_CASE}')"
    labels = _labels(column)
    return (
        f"CASE WHEN len({labels}) >= 2 AND trim({pieces}[1]) = '' AND len(list_distinct({labels})) = len({labels}) "
        f"THEN map({labels}, list_transform({pieces}[2:], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) END"
    )


def _limit_struct(text: str, stage: str) -> str:
    unit = f"lower(regexp_replace(regexp_extract({text}, '{_LIMIT}', 2), '\\s+', '', 'g'))"
    key = fold(text)
    return f"""CASE WHEN len(regexp_extract_all(coalesce({text}, ''), '{_LIMIT}', 0)) = 1 THEN struct_pack(
        v := CAST(regexp_extract({text}, '{_LIMIT}', 1) AS DOUBLE),
        u := CASE {unit} WHEN '%' THEN 'percent' ELSE {unit} END,
        c := CASE WHEN contains({key}, 'less than') AND NOT contains({key}, 'or equal') THEN 'less_than'
                  WHEN contains({key}, 'greater than') AND NOT contains({key}, 'or equal') THEN 'greater_than' ELSE 'less_than_or_equal' END,
        b := CASE WHEN regexp_extract({text}, '(?i)\\b(?:calculated|expressed)\\s+as\\s+([^\\n.;]+)', 1) <> '' THEN trim(regexp_extract({text}, '(?i)\\b(?:calculated|expressed)\\s+as\\s+([^\\n.;]+)', 1))
                  WHEN regexp_extract({text}, '(?i)\\(\\s*as\\s+([^)]+)\\)', 1) <> '' THEN trim(regexp_extract({text}, '(?i)\\(\\s*as\\s+([^)]+)\\)', 1)) END,
        s := CASE WHEN contains({key}, 'after mixing') THEN 'after_mixing' WHEN contains({key}, 'ready for use') THEN 'ready_for_use'
                  WHEN contains({key}, 'finished product') THEN 'finished_product'
                  WHEN contains({key}, 'ingredient') OR contains({key}, 'impurit') THEN 'ingredient' ELSE {stage} END) END"""


_TOKENS = "list_sort(list_distinct(list_transform(regexp_extract_all(cas_number_raw, '[0-9]{2,7}\\s*-\\s*[0-9]{1,3}\\s*-\\s*[0-9]?', 0), lambda t: regexp_replace(t, '\\s+', '', 'g'))))"
_OK = f"(regexp_full_match(t, '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]') AND {cas_ok('t')})"
_PHRASES = ["except", "exception", "unless", "when used", "if they contain", "provided that", "provided the", "shall be below", "does not exceed", "trace limit"]
_ANY = " OR ".join(f"contains(folded, '{p}')" for p in _PHRASES)

ENTITIES.update(
    {
        "o_facts": (
            ("records",),
            f"""
            SELECT *,
              CASE section WHEN 'Annex II Part 1' THEN 'acd-ii' WHEN 'Annex III Part 1' THEN 'acd-iii' WHEN 'Third Schedule Part I' THEN 'sg-third-schedule-i' ELSE 'sg-third-schedule-ii' END
                || '-' || trim(regexp_replace(lower(reference_number), '[^a-z0-9]+', '-', 'g'), '-') AS base_id,
              {fold('original_substance_name')} AS folded,
              section IN ('Annex II Part 1', 'Third Schedule Part I') AS prohibited,
              {fold('original_substance_name')} <> '' AND NOT regexp_full_match(reference_number, '(?i)A?[0-9]+[a-z]?\\s*(?:-|to)\\s*A?[0-9]+[a-z]?')
                AND {fold('original_substance_name')} NOT IN ('deleted', 'entry deleted', 'entry left intentionally blank', 'entry intentionally left blank', 'entries left intentionally blank')
                AND NOT starts_with({fold('original_substance_name')}, 'moved or deleted') AS active,
              list_filter({_TOKENS}, lambda t: {_OK}) AS valid, list_filter({_TOKENS}, lambda t: NOT {_OK}) AS malformed,
              {', '.join(f"{_map(column)} AS m{short}" for short, column in _FIELDS.items())},
              list_distinct(flatten([{', '.join(_labels(column) for column in _FIELDS.values())}])) AS markers,
              list_filter(list_transform(string_split(source_text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(lower(x), 'singapore|indonesia|malaysia|thailand|lao pdr')) AS notes
            FROM records
            """,
        ),
        "o_labels": (
            ("o_facts",),
            """
            SELECT *, CASE WHEN NOT prohibited AND active AND mc IS NOT NULL AND ml IS NOT NULL
                 AND map_keys(mc) = list_transform(range(len(map_keys(mc))), lambda i: chr(CAST(97 + i AS INT))) AND map_keys(ml) = map_keys(mc)
                 AND (mo IS NULL OR map_keys(mo) = map_keys(mc)) AND (mw IS NULL OR map_keys(mw) = map_keys(mc)) THEN map_keys(mc) END AS labels
            FROM o_facts
            """,
        ),
        "o_reasons": (
            ("o_labels",),
            f"""
            SELECT *, list_filter([
               CASE WHEN len(malformed) > 0 THEN 'malformed_cas_identifier_preserved' END,
               CASE WHEN flag_list <> '' AND flag_list <> 'entry_spans_multiple_pages' THEN 'nonstandard_extraction_fragment' END,
               CASE WHEN len(notes) > 0 THEN 'jurisdiction_specific_source_wording' END,
               CASE WHEN labels IS NULL AND (len(markers) >= 2 OR mc IS NOT NULL OR ml IS NOT NULL OR mo IS NOT NULL OR mw IS NOT NULL) THEN 'multi_case_mapping_not_unambiguous' END,
               CASE WHEN prohibited AND active AND ({_ANY}) THEN 'conditional_prohibition_wording_not_structured' END,
               CASE WHEN prohibited AND active AND contains(folded, 'not limited to the specified cas') THEN 'non_exhaustive_identifier_scope_not_structured' END,
               CASE WHEN NOT active THEN 'blank_deleted_or_ranged_source_entry' END], lambda x: x IS NOT NULL) AS base
            FROM o_labels
            """,
        ),
        "o_cases": (
            ("o_reasons",),
            """
            SELECT r.*, case_label,
               CASE WHEN case_label IS NULL OR coalesce(mc[case_label], '') = '' THEN original_field_of_use_text ELSE mc[case_label] END AS ctx,
               CASE WHEN case_label IS NULL OR coalesce(ml[case_label], '') = '' THEN original_concentration_text ELSE ml[case_label] END AS lim,
               CASE WHEN case_label IS NULL OR mo IS NULL OR coalesce(mo[case_label], '') = '' THEN original_conditions_text ELSE mo[case_label] END AS cond,
               CASE WHEN case_label IS NULL OR mw IS NULL OR coalesce(mw[case_label], '') = '' THEN original_warning_text ELSE mw[case_label] END AS warn
            FROM (SELECT *, unnest(coalesce(labels, [CAST(NULL AS VARCHAR)])) AS case_label FROM o_reasons) r
            """,
        ),
        "o_limits": (
            ("o_cases",),
            f"""
            SELECT *, {_limit_struct('lim', "CASE WHEN section = 'Annex III Part 1' THEN 'ready_for_use' ELSE 'finished_product' END")} AS own,
                   CASE WHEN NOT prohibited AND active AND coalesce(lim, '') = '' THEN {_limit_struct('cond', "'unspecified'")} END AS other,
                   len(regexp_extract_all(coalesce(lim, ''), '{_LIMIT}', 0)) > 0 AS hits,
                   len(regexp_extract_all(coalesce(cond, ''), '{_LIMIT}', 0)) > 0 AS cond_hits,
                   regexp_matches(coalesce(cond, ''), '(?i)[0-9]+(?:[.,][0-9]+)?\\s*(?:[μµ]g\\s*/\\s*kg|kda)\\b') AS second
            FROM o_cases
            """,
        ),
        "o_drafts": (
            ("o_limits",),
            """
            SELECT *, base_id || CASE WHEN case_label IS NULL THEN '' ELSE '-case-' || case_label END AS rule_id,
              CASE WHEN list_contains(base, 'multi_case_mapping_not_unambiguous') THEN NULL ELSE coalesce(own, other) END AS concentration,
              list_sort(list_distinct(list_concat(base, list_filter([
                CASE WHEN NOT prohibited AND active AND coalesce(lim, '') <> '' AND own IS NULL AND hits THEN 'concentration_contains_multiple_or_ambiguous_values' END,
                CASE WHEN NOT prohibited AND active AND coalesce(lim, '') = '' AND other IS NULL AND cond_hits THEN 'concentration_condition_not_normalized' END,
                CASE WHEN second THEN 'additional_numeric_condition_not_structured' END,
                CASE WHEN list_contains(base, 'multi_case_mapping_not_unambiguous') AND (hits OR cond_hits OR second) THEN 'ambiguous_multi_case_concentration_not_normalized' END],
                lambda x: x IS NOT NULL)))) AS reasons
            FROM o_limits
            """,
        ),
    }
)


# --- text jobs ------------------------------------------------------------------------------------

_FOLDED = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@register("normalize_names", f"SELECT doc_id, {_FOLDED.format('text')} AS key FROM documents")
def _(spark, d):
    return X.normalize_names(table(spark, d, "documents"), "text", "key").select("doc_id", "key")


@register("catalogue_keys", f"SELECT conv_id, turn, {_FOLDED.format('text')} AS key FROM conversations")
def _(spark, d):
    return X.catalogue_keys(table(spark, d, "conversations"), "text", "key").select("conv_id", "turn", "key")


@register("slug_ids", oracle("o_facts", "SELECT raw_record_id, base_id AS base_rule_id, 'substance-' || base_id AS base_substance_id FROM o_facts"))
def _(spark, d):
    return X.slug_ids(records(spark, d)).select("raw_record_id", "base_rule_id", "base_substance_id")


@register(
    "harvest_identifiers",
    oracle("o_facts", "SELECT raw_record_id, array_to_string(valid, '|') AS cas_numbers, array_to_string(malformed, '|') AS malformed_identifiers FROM o_facts"),
)
def _(spark, d):
    df = X.harvest_identifiers(records(spark, d), "cas_number_raw")
    return df.select("raw_record_id", pipe("cas_numbers").alias("cas_numbers"), pipe("malformed_identifiers").alias("malformed_identifiers"))


@register("identifier_checksum", oracle("parts", f"SELECT p_partkey, cas, {cas_ok('cas')} AS is_valid FROM parts"))
def _(spark, d):
    return entity(spark, d, "parts").select("p_partkey", "cas", X.identifier_checksum(F.col("cas")).alias("is_valid"))


@register(
    "parse_limits",
    oracle(
        "records",
        f"""p AS (SELECT raw_record_id, {_limit_struct('original_concentration_text', "'unspecified'")} AS x FROM records)
            SELECT raw_record_id, x.v AS value, x.u AS unit, x.c AS comparator, x.b AS basis, x.s AS preparation_stage FROM p""",
    ),
)
def _(spark, d):
    df = X.parse_limits(records(spark, d), "original_concentration_text", "maximum_concentration", "unspecified")
    return df.select("raw_record_id", "concentration.value", "concentration.unit", "concentration.comparator", "concentration.basis", "concentration.preparation_stage")


@register(
    "split_cases",
    oracle("o_facts", "SELECT raw_record_id, array_to_string(list_transform(map_entries(ml), lambda e: e.key || '=' || e.value), '|') AS cases FROM o_facts"),
)
def _(spark, d):
    df = X.split_cases(records(spark, d), "original_concentration_text")
    return df.select("raw_record_id", pipe(F.transform(F.map_entries("cases"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("cases"))


@register(
    "align_case_maps",
    oracle(
        "o_facts",
        """SELECT raw_record_id, CASE WHEN mc IS NOT NULL AND ml IS NOT NULL AND map_keys(mc) = ['a', 'b'] AND map_keys(ml) = ['a', 'b']
                  AND (mo IS NULL OR map_keys(mo) = ['a', 'b']) AND (mw IS NULL OR map_keys(mw) = ['a', 'b']) THEN 'a|b' END AS labels FROM o_facts""",
    ),
)
def _(spark, d):
    df = records(spark, d)
    for name, column in R.CASE_FIELDS.items():
        df = X.split_cases(df, column, f"m_{name}")
    aligned = X.align_case_maps(df, {name: f"m_{name}" for name in R.CASE_FIELDS})
    return aligned.select("raw_record_id", pipe("labels").alias("labels"))


@register(
    "conditional_wording_flags",
    f"""SELECT doc_id, ({' OR '.join(f"contains({_FOLDED.format('text')}, '{p}')" for p in _PHRASES)}) AS conditional_wording,
               contains({_FOLDED.format('text')}, 'not limited to the specified cas') AS non_exhaustive_scope FROM documents
        UNION ALL SELECT -1 - p_partkey, p_brand = 'Brand#24', p_brand = 'Brand#25' FROM part""",
)
def _(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "text")
    parts = table(spark, d, "part").select(
        (-1 - F.col("p_partkey")).alias("doc_id"),
        F.concat("p_name", F.when(F.col("p_brand") == "Brand#24", ", UNLESS rinsed").when(
            F.col("p_brand") == "Brand#25", ", not limited to  the specified CAS").otherwise("")).alias("text"),
    )
    return X.conditional_wording_flags(documents.unionByName(parts), "text").select("doc_id", "conditional_wording", "non_exhaustive_scope")


@register(
    "secondary_numeric_flags",
    oracle("records", "SELECT raw_record_id, coalesce(regexp_matches(original_conditions_text, '(?i)[0-9]+(?:[.,][0-9]+)?\\s*(?:[μµ]g\\s*/\\s*kg|kda)\\b'), false) AS secondary_numeric FROM records"),
)
def _(spark, d):
    return X.secondary_numeric_flags(records(spark, d), "original_conditions_text").select("raw_record_id", "secondary_numeric")


@register("inactive_entries", oracle("o_facts", "SELECT raw_record_id, active FROM o_facts"))
def _(spark, d):
    return X.inactive_entries(records(spark, d)).select("raw_record_id", "active")


@register(
    "derived_search_names",
    oracle(
        "substances",
        f"""SELECT substance_id, {fold('original_substance_name')} AS key FROM substances
            UNION SELECT substance_id, {fold("substr(original_substance_name, 1, strpos(lower(original_substance_name), ' (except ') - 1)")}
            FROM substances WHERE strpos(lower(original_substance_name), ' (except ') > 1""",
    ),
)
def _(spark, d):
    return X.derived_search_names(entity(spark, d, "substances"))


def amount_cells(spark, d):
    """Amount cells of every submitted line: with unit, bare, q.s. or other text."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    value = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" "), quantity, F.lit(" %")))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("."), quantity))
        .when(F.col("l_linenumber") == 3, "Q.S.")
        .when(F.col("l_linenumber") == 4, F.concat(quantity, F.lit(".25 mg / KG")))
        .when(F.col("l_linenumber") == 5, F.concat(quantity, F.lit("PPM ")))
        .when(F.col("l_linenumber") == 6, " balance ")
        .otherwise(F.concat(F.lit("about "), quantity))
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("source_value"))


_CELLS = """c AS (SELECT l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q,
    CASE l_linenumber WHEN 1 THEN ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' %' WHEN 2 THEN '.' || CAST(CAST(l_quantity AS INT) AS VARCHAR)
      WHEN 3 THEN 'Q.S.' WHEN 4 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.25 mg / KG' WHEN 5 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || 'PPM '
      WHEN 6 THEN ' balance ' ELSE 'about ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS source_value FROM lineitem)"""


@register(
    "parse_cell_amounts",
    f"""WITH {_CELLS} SELECT source_value, CASE l_linenumber WHEN 1 THEN CAST(q AS DOUBLE) WHEN 2 THEN CAST('0.' || q AS DOUBLE) WHEN 4 THEN CAST(q || '.25' AS DOUBLE) WHEN 5 THEN CAST(q AS DOUBLE) END AS amount,
        CASE l_linenumber WHEN 1 THEN 'percent' WHEN 4 THEN 'mg/kg' WHEN 5 THEN 'ppm' END AS unit,
        CASE WHEN l_linenumber IN (1, 4, 5) THEN 'with_unit' WHEN l_linenumber = 2 THEN 'bare' WHEN l_linenumber IN (3, 6) THEN 'unavailable' ELSE 'none' END AS amount_state,
        count(*) AS cells FROM c GROUP BY ALL""",
)
def _(spark, d):
    parsed = X.parse_cell_amounts(amount_cells(spark, d))
    return parsed.groupBy("source_value", "amount", "unit", "amount_state").agg(F.count("*").alias("cells"))


@register(
    "normalize_vocab",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'percent' WHEN '2-HIGH' THEN 'ppm' WHEN '3-MEDIUM' THEN 'mg/kg' END AS unit,
              CASE o_orderstatus WHEN 'F' THEN 'finished_product' WHEN 'O' THEN 'after_mixing' END AS stage FROM orders""",
)
def _(spark, d):
    words = table(spark, d, "orders").select(
        "o_orderkey",
        F.replace(F.replace(F.replace("o_orderpriority", F.lit("1-URGENT"), F.lit(" Percent ")), F.lit("2-HIGH"), F.lit("P P M")), F.lit("3-MEDIUM"), F.lit("MG / kg")).alias("unit_text"),
        F.when(F.col("o_orderstatus") == "F", " Finished - Product").when(F.col("o_orderstatus") == "O", "after mixing FOR-use").otherwise("other").alias("stage_text"),
    )
    return X.normalize_vocab(X.normalize_vocab(words, "unit_text", "unit", "unit"), "stage_text", "stage", "stage").select("o_orderkey", "unit", "stage")


# --- rules ----------------------------------------------------------------------------------------


@register(
    "normalize_rules",
    oracle(
        "o_drafts",
        """SELECT rule_id, CASE WHEN case_label IS NOT NULL THEN base_id END AS parent_rule_id, section AS regulatory_section,
                  CASE WHEN active THEN 'substance-' || base_id END AS substance_id, CASE WHEN prohibited THEN 'prohibited' ELSE 'restricted' END AS restriction_type,
                  ctx AS product_context, lim AS concentration_text, cond AS other_conditions, warn AS required_warning, active,
                  array_to_string(valid, '|') AS cas_numbers FROM o_drafts""",
    ),
)
def _(spark, d):
    return R.normalize_rules(records(spark, d)).select(
        "rule_id", "parent_rule_id", "regulatory_section", "substance_id", "restriction_type", "product_context",
        "concentration_text", "other_conditions", "required_warning", "active", pipe("cas_numbers").alias("cas_numbers"),
    )


@register(
    "normalize_substances",
    oracle(
        "o_facts",
        """SELECT 'substance-' || base_id AS substance_id, folded AS normalized_substance_name, array_to_string(valid, '|') AS cas_numbers,
                  array_to_string(malformed, '|') AS malformed_identifiers, cas_number_raw AS identifiers_raw FROM o_facts WHERE active""",
    ),
)
def _(spark, d):
    return R.normalize_substances(records(spark, d)).select(
        "substance_id", "normalized_substance_name", pipe("cas_numbers").alias("cas_numbers"),
        pipe("malformed_identifiers").alias("malformed_identifiers"), "identifiers_raw",
    )


@register(
    "rule_status",
    oracle(
        "o_drafts",
        """SELECT rule_id, CASE WHEN NOT active THEN 'inactive_source_entry' WHEN len(reasons) > 0 THEN 'manual_review_required' ELSE 'normalized' END AS normalization_status,
                  array_to_string(reasons, '|') AS review_reasons FROM o_drafts""",
    ),
)
def _(spark, d):
    return R.normalize_rules(records(spark, d)).select("rule_id", "normalization_status", pipe("review_reasons").alias("review_reasons"))


@register(
    "limit_fallback",
    oracle(
        "o_drafts",
        """SELECT rule_id, concentration.v AS value, concentration.u AS unit, concentration.c AS comparator, concentration.b AS basis, concentration.s AS preparation_stage,
                  CASE WHEN concentration IS NULL THEN NULL WHEN own IS NOT NULL THEN 'maximum_concentration' ELSE 'other_conditions' END AS source_field FROM o_drafts""",
    ),
)
def _(spark, d):
    df = R.normalize_rules(records(spark, d))
    return df.select("rule_id", *[F.col(f"concentration.{c}").alias(c) for c in ("value", "unit", "comparator", "basis", "preparation_stage", "source_field")])


def footnotes(spark, d):
    """Footnotes of both documents, one per text."""
    docs = table(spark, d, "documents")
    number = F.col("doc_id").cast("string")
    return docs.select(
        F.when(F.col("source") < "src2", "controlling_regulations").otherwise("advisory_annexes").alias("source_document"),
        number.alias("footnote_number"), F.col("doc_id").alias("source_page"), F.md5("text").alias("source_text"),
    )


_NOTES = """f AS (SELECT CASE WHEN source < 'src2' THEN 'controlling_regulations' ELSE 'advisory_annexes' END AS source_document,
    CAST(doc_id AS VARCHAR) AS footnote_number, doc_id AS source_page, md5(text) AS source_text FROM documents),
  cited AS (SELECT raw_record_id, source_document, unnest(string_split(note_list, ',')) AS footnote_number FROM records WHERE note_list <> '')"""


@register(
    "attach_footnotes",
    oracle(
        "records",
        f"""{_NOTES} SELECT raw_record_id, footnote_number, count(*) AS footnotes, CAST(sum(source_page) AS BIGINT) AS page_sum, min(source_text) AS first_text
            FROM cited JOIN f USING (source_document, footnote_number) GROUP BY ALL""",
    ),
)
def _(spark, d):
    attached = R.attach_footnotes(records(spark, d), footnotes(spark, d))
    return attached.groupBy("raw_record_id", "footnote_number").agg(
        F.count("*").alias("footnotes"), F.sum("source_page").alias("page_sum"), F.min("source_text").alias("first_text")
    )


@register(
    "contributing_pages",
    oracle(
        "records",
        f"""{_NOTES}, p AS (SELECT raw_record_id, source_page FROM records UNION SELECT raw_record_id, source_page FROM cited JOIN f USING (source_document, footnote_number))
            SELECT raw_record_id, count(*) AS pages, min(source_page) AS first_page, max(source_page) AS last_page FROM p GROUP BY 1""",
    ),
)
def _(spark, d):
    pages = R.contributing_pages(records(spark, d), R.attach_footnotes(records(spark, d), footnotes(spark, d)))
    return pages.groupBy("raw_record_id").agg(
        F.count("*").alias("pages"), F.min("source_page").alias("first_page"), F.max("source_page").alias("last_page")
    )


@register(
    "build_catalogue",
    oracle(
        "glossary",
        """SELECT 'entry-' || lpad(CAST(min(entry_number) AS VARCHAR), 7, '0') AS ingredient_id, min_by(canonical_name, entry_number) AS canonical_name,
                  lower(replace(canonical_name, '  ', ' ')) AS search_name, count(*) AS source_rows, min(source_page) AS first_page, max(source_page) AS last_page
           FROM glossary GROUP BY lower(replace(canonical_name, '  ', ' '))""",
    ),
)
def _(spark, d):
    return R.build_catalogue(entity(spark, d, "glossary"), width=7)


@register(
    "catalogue_sources",
    oracle(
        "glossary catalogue",
        """SELECT c.ingredient_id, g.entry_number, g.source_page, g.raw_record_id
           FROM glossary g JOIN catalogue c ON c.search_name = lower(replace(g.canonical_name, '  ', ' '))""",
    ),
)
def _(spark, d):
    glossary = entity(spark, d, "glossary")
    return R.catalogue_sources(glossary, R.build_catalogue(glossary, width=7))


@register(
    "catalogue_key_collisions",
    oracle(
        "glossary",
        """SELECT lower(replace(canonical_name, '  ', ' ')) AS search_name, CASE WHEN count(DISTINCT canonical_name) > 1 THEN 'different_names' ELSE 'duplicate_rows' END AS kind,
                  count(*) AS source_rows, min(entry_number) AS first_entry FROM glossary GROUP BY 1 HAVING count(*) > 1""",
    ),
)
def _(spark, d):
    return R.catalogue_key_collisions(entity(spark, d, "glossary"))
