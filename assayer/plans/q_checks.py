"""Registered queries of search, data quality, review and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import constants as K
from assayer.operators import linkage as L
from assayer.operators import quality as V
from assayer.operators import review as K_
from assayer.operators import rules as R
from assayer.operators import search as Q
from assayer.sources import snapshots as S
from assayer.plans.adapters import entity, oracle, stage, table
from assayer.plans.oracle_parts import cas_ok
from assayer.plans.q_screening import snapshot
from assayer.session import materialize
from assayer.sources import extraction as E

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


def rules(spark, d):
    return entity(spark, d, "rules")


# --- search ---------------------------------------------------------------------------------------


def searches(spark, d):
    """What people type: family words, name starts, whole names and single letters."""
    part = table(spark, d, "part")
    typed = F.array(
        F.substring("p_name", 1, 3), F.substring_index("p_name", " ", -1), F.upper("p_name"), F.substring("p_brand", -2, 2),
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")), F.substring("p_name", 2, 4), F.substring("p_name", 1, 1),
    )
    return part.select(F.explode(typed).alias("query")).distinct()


_SEARCHES = """typed AS (SELECT unnest([substr(p_name, 1, 3), split_part(p_name, ' ', -1), upper(p_name), right(p_brand, 2), p_name || ' ' || CAST(p_size AS VARCHAR), substr(p_name, 2, 4), substr(p_name, 1, 1)]) AS query FROM part),
    qs AS (SELECT DISTINCT trim(lower(regexp_replace(query, '\\s+', ' ', 'g'))) AS q FROM typed WHERE length(trim(query)) >= 2)"""
_RANKED = """hit AS (SELECT q, ingredient_id, canonical_name, search_name, CASE WHEN search_name = q THEN 0 WHEN starts_with(search_name, q) THEN 1 ELSE 2 END AS rank FROM qs JOIN catalogue ON contains(search_name, q)),
    top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, search_name, ingredient_id) AS position FROM hit)"""


@register(
    "prefix_search",
    oracle("catalogue", _SEARCHES + " SELECT q AS query_key, search_name, ingredient_id FROM qs JOIN catalogue ON starts_with(search_name, q)"),
)
def _(spark, d):
    return Q.prefix_search(searches(spark, d), entity(spark, d, "catalogue"))


@register(
    "ranked_catalogue_search",
    oracle(
        "catalogue",
        f"""{_SEARCHES}, {_RANKED} SELECT q AS query_key, CAST(position AS INT) AS position, rank, ingredient_id, search_name,
            CASE WHEN regexp_full_match(canonical_name, '[A-Z]+(?: [A-Z]+)*') THEN upper(substr(canonical_name, 1, 1)) || lower(substr(canonical_name, 2)) ELSE canonical_name END AS display_name
            FROM top WHERE position <= 20""",
    ),
)
def _(spark, d):
    return Q.ranked_catalogue_search(searches(spark, d), entity(spark, d, "catalogue"))


_RULE_HITS = """keys AS (SELECT rule_id, regulatory_section, lower(substance_name) AS k FROM rules WHERE active AND side = 'adv'
      UNION SELECT rule_id, regulatory_section, lower(substr(substance_name, 1, strpos(substance_name, ' (except ') - 1)) FROM rules WHERE active AND side = 'adv' AND strpos(substance_name, ' (except ') > 1),
    firsts AS (SELECT rule_id, min(k) AS first_key FROM keys GROUP BY 1),
    rhit AS (SELECT q, rule_id, regulatory_section, min(CASE WHEN k = q THEN 0 WHEN starts_with(k, q) THEN 1 ELSE 2 END) AS rank FROM qs JOIN keys ON contains(k, q) GROUP BY ALL),
    rtop AS (SELECT r.*, first_key, row_number() OVER (PARTITION BY q ORDER BY rank, first_key, regulatory_section, rule_id) AS position FROM rhit r JOIN firsts USING (rule_id))"""


@register(
    "ranked_rule_search",
    oracle("rules", f"{_SEARCHES}, {_RULE_HITS} SELECT q AS query_key, CAST(position AS INT) AS position, rank, rule_id, regulatory_section, first_key FROM rtop WHERE position <= 20"),
)
def _(spark, d):
    return Q.ranked_rule_search(searches(spark, d), rules(spark, d))


@register(
    "combined_search",
    oracle(
        "rules catalogue",
        f"""{_SEARCHES}, {_RANKED}, {_RULE_HITS} SELECT q AS query_key, 'eu' AS source, CAST(position AS INT) AS position, rank, ingredient_id AS item FROM top WHERE position <= 10
            UNION ALL SELECT q, 'acd', CAST(position AS INT), rank, rule_id FROM rtop WHERE position <= 10""",
    ),
)
def _(spark, d):
    return Q.combined_search(searches(spark, d), entity(spark, d, "catalogue"), rules(spark, d))


# --- quality --------------------------------------------------------------------------------------


@register(
    "duplicate_keys",
    oracle(
        "rules glossary",
        """SELECT 'duplicate_rule_name' AS code, substance_name AS key, CAST(count(*) AS VARCHAR) AS detail FROM rules GROUP BY 2 HAVING count(*) > 1
           UNION ALL SELECT 'duplicate_rule_id', rule_id, CAST(count(*) AS VARCHAR) FROM rules GROUP BY 2 HAVING count(*) > 1
           UNION ALL SELECT 'duplicate_canonical_name', canonical_name, CAST(count(*) AS VARCHAR) FROM glossary GROUP BY 2 HAVING count(*) > 1
           UNION ALL SELECT 'duplicate_raw_record_id', raw_record_id, CAST(count(*) AS VARCHAR) FROM rules GROUP BY 2 HAVING count(*) > 1""",
    ),
)
def _(spark, d):
    r = rules(spark, d)
    return V.duplicate_keys(
        {
            "duplicate_rule_name": (r, "substance_name"), "duplicate_rule_id": (r, "rule_id"),
            "duplicate_canonical_name": (entity(spark, d, "glossary"), "canonical_name"), "duplicate_raw_record_id": (r, "raw_record_id"),
        }
    )


@register(
    "expected_counts",
    """SELECT 'unexpected_count' AS code, coalesce(a.source, b.source) AS key, 'expected ' || coalesce(b.n, 0) || ', found ' || coalesce(a.n, 0) AS detail
       FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) a FULL OUTER JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) b ON a.source = b.source
       WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def _(spark, d):
    docs = table(spark, d, "documents")

    def counts(df):
        return df.groupBy(F.col("source").alias("item")).agg(F.count("*").alias("row_count"))

    return V.expected_counts(counts(docs), counts(docs.join(table(spark, d, "labels"), "doc_id")))


@register(
    "page_table_counts",
    """WITH l AS (SELECT source, lang, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
        k AS (SELECT *, CASE WHEN length(line) > 120 THEN 1 ELSE 0 END AS opens FROM l WHERE length(line) > 90 OR trim(line) <> ''),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY source, lang ORDER BY doc_id, i) AS island FROM k)
       SELECT 'column_or_table_count_error' AS code, source || ':' || doc_id AS key, CAST(n AS VARCHAR) AS detail FROM (SELECT source, doc_id, len(string_split(text, chr(10))) AS n FROM documents) WHERE n <> 1
       UNION ALL SELECT 'unassigned_continuation_fragment', source || ':' || doc_id,
          CASE WHEN length(line) > 90 THEN 'see above' ELSE '' END || ' | ' || regexp_replace(line, '^\\s+|\\s+$', '', 'g') FROM s WHERE island = 0""",
)
def _(spark, d):
    from assayer.plans.q_sources import table_rows

    diagnostics = table(spark, d, "documents").select(
        F.col("source").alias("source_document"), F.col("doc_id").alias("source_page"), F.size(F.split("text", "\n")).alias("table_count"), "text"
    )
    return V.page_table_counts(diagnostics, E.stitch_continuation_rows(table_rows(spark, d)))


@register(
    "sequence_gaps",
    """WITH n AS (SELECT DISTINCT l_orderkey AS x FROM lineitem), o AS (SELECT x, lead(x) OVER (ORDER BY x) AS y FROM n)
       SELECT 'sequence_gap' AS code, CAST(x + 1 AS VARCHAR) AS key, (x + 1) || '-' || (y - 1) AS detail FROM o WHERE y > x + 1
       UNION ALL SELECT 'sequence_gap', '1', '1-' || (min(x) - 1) FROM n HAVING min(x) > 1""",
)
def _(spark, d):
    return V.sequence_gaps(table(spark, d, "lineitem"), "l_orderkey")


@register(
    "missing_provenance",
    oracle(
        "rules",
        """SELECT 'missing_rule_provenance' AS code, rule_id AS key, concat_ws(',', CASE WHEN product_context IS NULL THEN 'product_context' END, CASE WHEN limit_basis IS NULL THEN 'limit_basis' END,
                  CASE WHEN reason_list = '' THEN 'review_reasons' END) AS detail FROM rules WHERE product_context IS NULL OR limit_basis IS NULL OR reason_list = ''""",
    ),
)
def _(spark, d):
    return V.missing_provenance(rules(spark, d), "rule_id", ["source_text", "raw_record_id", "product_context", "limit_basis", "review_reasons"], "missing_rule_provenance")


@register(
    "broken_links",
    oracle(
        "rules records",
        """SELECT CASE WHEN w.raw_record_id IS NULL THEN 'broken_raw_link' ELSE 'source_text_loss' END AS code, r.rule_id AS key, CAST(NULL AS VARCHAR) AS detail
           FROM rules r LEFT JOIN (SELECT * FROM records WHERE side = 'ctl') w ON w.raw_record_id = r.raw_record_id WHERE w.raw_record_id IS NULL OR w.source_text IS DISTINCT FROM r.source_text""",
    ),
)
def _(spark, d):
    return V.broken_links(rules(spark, d), entity(spark, d, "records").filter("side = 'ctl'"))


@register(
    "allowed_values",
    "SELECT 'unknown_status' AS code, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS detail FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')",
)
def _(spark, d):
    return V.allowed_values(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", ("1-URGENT", "2-HIGH", "5-LOW"), "unknown_status")


@register(
    "invalid_limits",
    "SELECT 'invalid_parsed_concentration' AS code, CAST(c_custkey AS VARCHAR) AS key, concat_ws(' ', CAST(round(c_acctbal) AS VARCHAR), CASE WHEN c_mktsegment = 'BUILDING' THEN 'g/l' ELSE 'percent' END) AS detail FROM customer WHERE round(c_acctbal) < 0 OR c_mktsegment = 'BUILDING' OR round(c_acctbal) > 100",
)
def _(spark, d):
    limits = table(spark, d, "customer").select(
        F.col("c_custkey").alias("rule_id"),
        F.struct(F.round("c_acctbal").alias("value"), F.when(F.col("c_mktsegment") == "BUILDING", "g/l").otherwise("percent").alias("unit")).alias("concentration"),
    )
    return V.invalid_limits(limits)


@register(
    "identifier_recheck",
    oracle(
        "o_facts",
        f"""a AS (SELECT * FROM o_facts WHERE active)
            SELECT 'lost_or_changed_valid_cas_identifier' AS code, raw_record_id AS key, array_to_string(valid, ',') AS detail FROM a WHERE array_to_string(valid, ',') <> cas_number_raw
            UNION ALL SELECT 'lost_or_changed_malformed_cas_identifier', raw_record_id, array_to_string(malformed, ',') FROM a WHERE len(malformed) > 0
            UNION ALL SELECT 'malformed_normalized_cas', 'substance-' || base_id, cas_number_raw FROM a WHERE NOT {cas_ok('cas_number_raw')}""",
    ),
)
def _(spark, d):
    """Stored lists keep the raw text as it is, so texts with several or odd numbers stand out."""
    raw = entity(spark, d, "records")
    stored = R.normalize_substances(raw).withColumn("cas_numbers", F.array("identifiers_raw")).withColumn("malformed_identifiers", F.array().cast("array<string>"))
    as_rules = stored.select(F.col("substance_id").alias("rule_id"), "cas_numbers")
    return V.identifier_recheck(as_rules, stored, raw)


@register(
    "link_direction",
    oracle(
        "o_sides o_status",
        """SELECT DISTINCT 'incorrect_cross_reference_direction' AS code, s.xref_id AS key, x.rule_id AS detail FROM o_sides x JOIN o_status s ON s.mapping = x.mapping AND s.ref = x.ref WHERE s.status = 'changed'""",
    ),
)
def _(spark, d):
    links = snapshot(spark, d)["links"]
    # sides of changed references are swapped to seed the fault
    swapped = F.when(F.col("comparison_status") == "changed", F.when(F.col("side") == "acd", "singapore").otherwise("acd")).otherwise(F.col("side"))
    return V.link_direction(links.withColumn("side", swapped))


@register(
    "required_keys_present",
    "SELECT DISTINCT 'missing_regression_reference' AS code, CAST(l_partkey AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)",
)
def _(spark, d):
    required = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    return V.required_keys_present(required, table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("key")), "missing_regression_reference")


@register(
    "required_names",
    oracle(
        "glossary catalogue",
        """q AS (SELECT DISTINCT upper(p_name) || ' ' || p_size AS canonical_name FROM part WHERE p_size < 6),
           f AS (SELECT c.canonical_name, g.entry_number, g.source_page FROM catalogue c JOIN glossary g ON lower(replace(g.canonical_name, '  ', ' ')) = c.search_name)
           SELECT q.canonical_name, f.canonical_name IS NOT NULL AS present, f.entry_number, f.source_page FROM q LEFT JOIN f ON f.canonical_name = q.canonical_name""",
    ),
)
def _(spark, d):
    """Names of small parts, of which some are spelled otherwise in the catalogue."""
    part = table(spark, d, "part").filter("p_size < 6")
    names = part.select(F.concat(F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string")).alias("canonical_name"))
    catalogue = entity(spark, d, "catalogue")
    return V.required_names(names, catalogue, R.catalogue_sources(entity(spark, d, "glossary"), catalogue))


@register(
    "forbidden_terms",
    "SELECT 'obsolete_regulation_terminology' AS code, source AS key, CAST(count(*) AS VARCHAR) AS detail FROM documents WHERE contains(lower(text), 'license') GROUP BY 2",
)
def _(spark, d):
    return V.forbidden_terms(table(spark, d, "documents").select(F.col("source").alias("file"), "text"), "license")


@register(
    "spot_check_sample",
    oracle(
        "records",
        """SELECT 'spot-' || CASE WHEN p_partkey < 10 THEN '0' ELSE '' END || CAST(p_partkey AS VARCHAR) AS check_id, 'Annex II Part 1' AS section, 'a' || CAST(p_partkey AS VARCHAR) AS reference_number, p_name AS focus,
                  r.raw_record_id, r.raw_record_id IS NULL AS missing
           FROM part LEFT JOIN (SELECT lower(reference_number) AS ref, min(raw_record_id) AS raw_record_id FROM records WHERE section = 'Annex II Part 1' GROUP BY 1) r ON r.ref = 'a' || CAST(p_partkey AS VARCHAR)""",
    ),
)
def _(spark, d):
    samples = table(spark, d, "part").select(
        F.col("p_partkey").alias("position"), F.lit("Annex II Part 1").alias("section"),
        F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("reference_number"), F.col("p_name").alias("focus"),
    )
    return V.spot_check_sample(samples, entity(spark, d, "records"))


@register(
    "spot_check_reconcile",
    """WITH r AS (SELECT source || lang AS check_id, count(*) AS n, bool_or(quality <> 1) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1),
            e AS (SELECT DISTINCT source || lang AS check_id FROM documents)
       SELECT CASE WHEN r.n IS NULL OR r.n > 1 THEN 'spot_check_result_set_mismatch' ELSE 'incomplete_or_failed_manual_spot_checks' END AS code, e.check_id AS key, CAST(NULL AS VARCHAR) AS detail
       FROM e LEFT JOIN r USING (check_id) WHERE r.n IS NULL OR r.n > 1 OR r.bad
       UNION ALL SELECT 'spot_check_dataset_version_mismatch', 'spot_checks', 'v0' FROM (SELECT count(*) AS n FROM documents) WHERE n > 0
       UNION ALL SELECT 'spot_check_baseline_hash_mismatch', 'spot_checks', 'ABC' FROM (SELECT count(*) AS n FROM documents) WHERE n > 0""",
)
def _(spark, d):
    docs, results = spot_checks(spark, d)
    given = docs.limit(1).select(F.lit("v0").alias("dataset_version"), F.lit("ABC").alias("accepted_baseline_sha256"))
    return V.spot_check_reconcile(docs.select("check_id").distinct(), results, given, "v1", "abd")


def spot_checks(spark, d):
    docs = table(spark, d, "documents").withColumn("check_id", F.concat("source", "lang"))
    results = docs.join(table(spark, d, "labels"), "doc_id").select(
        "check_id", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("result"), F.lit("page").alias("evidence_checked"), F.lit("ok").alias("notes")
    )
    return docs, results


@register(
    "spot_check_counts",
    """SELECT (SELECT count(DISTINCT source || lang) FROM documents) AS spot_checks, count(*) FILTER (quality = 1) AS completed_spot_checks FROM documents JOIN labels USING (doc_id)""",
)
def _(spark, d):
    docs, results = spot_checks(spark, d)
    return V.spot_check_counts(docs.select("check_id").distinct(), results)


_OUTPUTS = """o AS (SELECT source AS item, sha256(string_agg(text, '' ORDER BY doc_id)) AS now, sha256(string_agg(text, '' ORDER BY doc_id) FILTER (doc_id % 7 <> 3 OR source <> 'src5')) AS before FROM documents GROUP BY 1)"""


def outputs(spark, d):
    """Fingerprints of this run's outputs, and of an accepted run in which one output had fewer rows."""
    docs = table(spark, d, "documents")
    prints = lambda df: S.row_fingerprint(df, ["source"]).select(F.col("source").alias("item"), "fingerprint")
    return prints(docs), prints(docs.filter("doc_id % 7 <> 3 OR source <> 'src5'"))


@register(
    "baseline_issues",
    f"""WITH {_OUTPUTS} SELECT 'accepted_output_baseline_mismatch' AS code, item AS key, CASE WHEN before IS NULL THEN 'extra' ELSE 'changed' END AS detail FROM o WHERE now IS DISTINCT FROM before""",
)
def _(spark, d):
    now, accepted = outputs(spark, d)
    return V.baseline_issues(now, accepted, "v1", "v1")


@register(
    "validation_report",
    oracle(
        "rules o_status",
        f"""{_OUTPUTS}, e AS (SELECT 'duplicate_raw_record_id' AS code, raw_record_id AS key FROM rules GROUP BY raw_record_id HAVING count(*) > 1
              UNION ALL SELECT 'accepted_output_baseline_mismatch', item FROM o WHERE now IS DISTINCT FROM before)
           SELECT 'validation_status' AS metric, CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END AS value FROM e
           UNION ALL SELECT 'errors:' || code, CAST(count(*) AS VARCHAR) FROM e GROUP BY code
           UNION ALL SELECT 'rules:' || normalization_status, CAST(count(*) AS VARCHAR) FROM rules GROUP BY normalization_status
           UNION ALL SELECT 'cross_references:' || status, CAST(count(*) AS VARCHAR) FROM o_status GROUP BY status
           UNION ALL SELECT 'warnings:' || 'unlabelled_document', CAST(count(*) AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) HAVING count(*) > 0
           UNION ALL SELECT 'count:normalized_rules', CAST(count(*) AS VARCHAR) FROM rules
           UNION ALL SELECT 'count:cross_references', CAST(count(*) AS VARCHAR) FROM o_status
           UNION ALL SELECT 'accepted_baseline_status', CASE WHEN count(*) > 0 THEN 'mismatched' ELSE 'matched' END FROM o WHERE now IS DISTINCT FROM before
           UNION ALL SELECT 'reproducibility_status', 'matched_previous_run'""",
    ),
)
def _(spark, d):
    now, accepted = outputs(spark, d)
    errors = V.duplicate_keys({"duplicate_raw_record_id": (rules(spark, d), "raw_record_id")}).unionByName(V.baseline_issues(now, accepted, "v1", "v1"))
    unlabelled = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    warnings = V.issues(unlabelled, "unlabelled_document", "doc_id")
    references = snapshot(spark, d)["cross_references"]
    counted = {"normalized_rules": rules(spark, d), "cross_references": references}
    return V.validation_report(errors, rules(spark, d), references, counted, warnings, now, outputs(spark, d)[0])


@register(
    "source_metadata_check",
    """SELECT CASE WHEN page_id % 11 = 0 THEN 'source_without_expected_hash' ELSE 'source_hash_changed' END AS code, CAST(page_id AS VARCHAR) AS key, sha256(html) AS detail FROM pages WHERE length(html) > 2000 OR page_id % 11 = 0
       UNION ALL SELECT 'source_missing', CAST(-1 - page_id AS VARCHAR), NULL FROM pages WHERE page_id % 13 = 0
       UNION ALL SELECT 'missing_snapshot_metadata', CAST(page_id AS VARCHAR), CASE WHEN url LIKE '%?%' THEN 'effective_date,' ELSE '' END || 'retrieval_date,snapshot_generated_at' FROM pages""",
)
def _(spark, d):
    """Some sources have no expected hash, some expected ones are gone, and two fields are absent as columns."""
    pages = table(spark, d, "pages").withColumnRenamed("page_id", "source_document")
    manifest = pages.select(
        "source_document", F.sha2("html", 256).alias("sha256"), F.col("url").alias("source_url"),
        F.when(~F.col("url").contains("?"), "2025-12-01").alias("effective_date"), "html",
    )
    expected = manifest.filter("source_document % 11 <> 0").select(
        "source_document", F.when(F.length("html") > 2000, "old").otherwise(F.col("sha256")).alias("sha256")
    )
    gone = pages.filter("source_document % 13 = 0").select((-1 - F.col("source_document")).alias("source_document"), F.lit("gone").alias("sha256"))
    return V.source_metadata_check(manifest.drop("html"), expected.unionByName(gone))


# --- review ---------------------------------------------------------------------------------------


@register(
    "review_queue",
    oracle(
        "o_status",
        """SELECT 'normalized_rule' AS item_type, rule_id AS item_id, reference_number, regulatory_section, CAST(NULL AS VARCHAR) AS comparison_status, replace(reason_list, ',', '|') AS review_reasons FROM rules WHERE normalization_status <> 'normalized'
           UNION ALL SELECT 'cross_reference', xref_id, reference_number, NULL, status, NULL FROM o_status WHERE status <> 'aligned'""",
    ),
)
def _(spark, d):
    queue = K_.review_queue(rules(spark, d), snapshot(spark, d)["cross_references"])
    return queue.select(
        "item_type", "item_id", "reference_number", "regulatory_section", "comparison_status",
        F.when(F.col("item_type") == "normalized_rule", pipe("review_reasons")).alias("review_reasons"),
    )


@register(
    "case_keys",
    oracle("o_sides o_status", "SELECT x.rule_id, s.xref_id AS case_key FROM o_sides x JOIN o_status s ON s.mapping = x.mapping AND s.ref = x.ref"),
)
def _(spark, d):
    return K_.case_keys(rules(spark, d), snapshot(spark, d)["links"]).select("rule_id", "case_key")


_PACK = """k AS (SELECT x.*, s.xref_id, s.status, s.changed, regexp_replace(lower(x.reference_number), '^a', '') AS bare FROM o_sides x JOIN o_status s ON s.mapping = x.mapping AND s.ref = x.ref),
    c AS (SELECT 1 AS p, 'conditional_prohibition' AS category, xref_id, rule_id, (adv, coalesce(TRY_CAST(regexp_replace(bare, '[^0-9]', '', 'g') AS BIGINT), 1000000000), bare, rule_id) AS o FROM k WHERE list_contains(string_split(reason_list, ','), 'conditional_prohibition_wording_not_structured')
      UNION ALL SELECT 2, 'ambiguous_multi_case_restriction', xref_id, rule_id, (adv, coalesce(TRY_CAST(regexp_replace(bare, '[^0-9]', '', 'g') AS BIGINT), 1000000000), bare, rule_id) FROM k WHERE list_contains(string_split(reason_list, ','), 'multi_case_mapping_not_unambiguous')
      UNION ALL SELECT 3, 'secondary_numerical_condition', xref_id, rule_id, (adv, coalesce(TRY_CAST(regexp_replace(bare, '[^0-9]', '', 'g') AS BIGINT), 1000000000), bare, rule_id) FROM k WHERE list_contains(string_split(reason_list, ','), 'additional_numeric_condition_not_structured')
      UNION ALL SELECT 4, 'active_acd_only', xref_id, min(rule_id), (false, 0, min(reference_number), min(rule_id)) FROM k WHERE status = 'acd_only' AND adv AND active GROUP BY xref_id
      UNION ALL SELECT 5, 'materially_changed_cross_reference', xref_id, min(rule_id), (false, 0, min(reference_number), min(rule_id)) FROM k WHERE status = 'changed' AND NOT adv AND (contains(changed, 'product_context') OR contains(changed, 'concentration') OR contains(changed, 'other_conditions') OR contains(changed, 'required_warning')) GROUP BY xref_id),
    f AS (SELECT p, category, xref_id, min(o) AS o, min_by(rule_id, o) AS rule_id FROM c GROUP BY ALL),
    s1 AS (SELECT * FROM f WHERE p = 1 ORDER BY o LIMIT 5),
    s2 AS (SELECT * FROM f WHERE p = 2 AND xref_id NOT IN (SELECT xref_id FROM s1) ORDER BY o LIMIT 5),
    s3 AS (SELECT * FROM f WHERE p = 3 AND xref_id NOT IN (SELECT xref_id FROM s1 UNION SELECT xref_id FROM s2) ORDER BY o LIMIT 5),
    s4 AS (SELECT * FROM f WHERE p = 4 AND xref_id NOT IN (SELECT xref_id FROM s1 UNION SELECT xref_id FROM s2 UNION SELECT xref_id FROM s3) ORDER BY o LIMIT 5),
    s5 AS (SELECT * FROM f WHERE p = 5 AND xref_id NOT IN (SELECT xref_id FROM s1 UNION SELECT xref_id FROM s2 UNION SELECT xref_id FROM s3 UNION SELECT xref_id FROM s4) ORDER BY o LIMIT 5),
    pack AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5)"""


def pack(spark, d):
    views = snapshot(spark, d)
    build = lambda: materialize(
        K_.stratified_review_sample(K_.review_candidates(rules(spark, d), views["cross_references"], views["links"])), "review-pack"
    )
    return stage(spark, d, "review-pack", build)


@register(
    "stratified_review_sample",
    oracle("o_sides o_status", _PACK + " SELECT p AS priority, category, xref_id AS case_key, rule_id FROM pack"),
)
def _(spark, d):
    return pack(spark, d)


@register(
    "review_cases",
    oracle(
        "o_sides o_status o_candidates",
        _PACK + f""", rr AS (SELECT o.rule_id, list_filter(string_split(o.reason_list, ','), lambda x: x <> '') || list_sort(list_filter([
                        CASE WHEN s.status = 'changed' THEN 'source_wording_or_regulatory_field_differs' END, CASE WHEN s.status = 'acd_only' THEN 'no_current_singapore_reference_number_match' END,
                        CASE WHEN s.status = 'singapore_only' THEN 'no_acd_2026_1_reference_number_match' END,
                        CASE WHEN EXISTS (SELECT 1 FROM o_candidates c WHERE c.mapping = s.mapping AND c.ref = s.ref) THEN 'same_normalized_substance_name_found_under_different_reference' END,
                        CASE WHEN s.status = 'ambiguous' AND regexp_full_match(s.reference_number, '(?i)A?[0-9]+[a-z]?\\s*(?:-|to)\\s*A?[0-9]+[a-z]?') THEN 'ranged_reference_prevents_unique_entry_correspondence'
                             WHEN s.status = 'ambiguous' THEN 'normalized_case_structure_differs_between_sources' END], lambda x: x IS NOT NULL)) AS l FROM o_sides o JOIN o_status s ON s.mapping = o.mapping AND s.ref = o.ref)
                    SELECT 'review-' || p.category || '-' || p.rule_id AS case_id, p.p AS priority, p.category, k.reference_number, k.substance_name, k.normalization_status, k.xref_id AS cross_reference_id, k.status AS cross_reference_status,
                      array_to_string(list_filter(rr.l, lambda x, i: list_position(rr.l, x) = i), '|') AS review_reasons, CASE p.category {" ".join(f"WHEN '{c}' THEN '{q.replace(chr(39), chr(39) * 2)}'" for c, q in K.REVIEW_QUESTIONS.items())} END AS reviewer_question
                    FROM pack p JOIN k ON k.rule_id = p.rule_id JOIN rr ON rr.rule_id = p.rule_id""",
    ),
)
def _(spark, d):
    views = snapshot(spark, d)
    return K_.review_cases(pack(spark, d), rules(spark, d), views["cross_references"], views["links"]).select(
        "case_id", "priority", "category", "reference_number", "substance_name", "normalization_status", "cross_reference_id", "cross_reference_status",
        F.array_join("review_reasons", "|").alias("review_reasons"), "reviewer_question",
    )


@register(
    "case_sources",
    oracle(
        "o_sides o_status",
        _PACK + """ SELECT 'review-' || p.category || '-' || p.rule_id AS case_id, CASE WHEN k2.adv THEN 1 ELSE 0 END AS rank, k2.rule_id, k2.regulatory_section, k2.reference_number
                    FROM pack p JOIN k ON k.rule_id = p.rule_id JOIN k k2 ON k2.xref_id = k.xref_id""",
    ),
)
def _(spark, d):
    views = snapshot(spark, d)
    cases = K_.review_cases(pack(spark, d), rules(spark, d), views["cross_references"], views["links"])
    return K_.case_sources(cases, views["links"], rules(spark, d))


# --- linkage --------------------------------------------------------------------------------------

BINDINGS = {"identity_dataset_version": "catalogue-1", "singapore_regulatory_baseline": "base-1"}


def linkable(spark, d):
    """Identities named like regulated substances, so that links exist."""
    return rules(spark, d).groupBy(F.lower("substance_name").alias("search_name")).agg(
        F.concat(F.lit("id-"), F.min("rule_id")).alias("ingredient_id"), F.min("substance_name").alias("canonical_name")
    )


_LINKABLE = "lk AS (SELECT lower(substance_name) AS search_name, 'id-' || min(rule_id) AS ingredient_id, min(substance_name) AS canonical_name FROM rules GROUP BY 1)"


@register(
    "linkage_candidates",
    oracle(
        "o_lookup rules",
        f"""{_LINKABLE}, cand AS (SELECT DISTINCT l.key, r.rule_id, r.regulatory_section AS part, r.reference_number AS reference FROM o_lookup l JOIN rules r ON r.substance_id = l.substance_id AND r.active WHERE l.method = 'exact_name' AND NOT l.advisory)
            SELECT lk.ingredient_id AS catalogue_ingredient_id, lk.canonical_name AS catalogue_canonical_name, c.rule_id, c.part, c.reference,
              CASE WHEN c.rule_id IS NULL THEN 'No deterministic Singapore candidate identified.' ELSE 'Exact normalized Singapore candidate identified; professional verification is required.' END AS reason_for_review,
              'unresolved' AS current_status FROM lk LEFT JOIN cand c ON c.key = lk.search_name""",
    ),
)
def _(spark, d):
    identities = linkable(spark, d)
    requested = identities.select(F.col("ingredient_id").alias("catalogue_ingredient_id"))
    hashed = rules(spark, d).withColumn("source_hash", F.md5("source_document"))
    return L.linkage_candidates(requested, identities, snapshot(spark, d)["lookup"], hashed)


def decisions(spark, d):
    """One decision per controlling rule record; sizes and brands seed the faults."""
    r = rules(spark, d).filter("side = 'ctl' and case_label is null")
    size = F.col("limit_value") * 10
    review = F.struct(
        (F.col("limit_unit") != "ppm").alias("reviewed"),
        F.when(F.col("limit_comparator") == "less_than", "yesterday").otherwise("2025-12-01T10:00:00Z").alias("reviewed_at"),
        F.when(F.col("required_warning").isNotNull(), " ").otherwise("R. Viewer").alias("reviewer"),
        F.lit("label check").alias("review_basis"),
    )
    return r.select(
        F.concat(F.lit("id-"), "rule_id").alias("catalogue_ingredient_id"),
        F.when(size == 7, F.upper("substance_name")).otherwise(F.col("substance_name")).alias("catalogue_canonical_name"),
        F.when(size == 5, "maybe").when(size < 5, "verified_not_represented").otherwise("linked").alias("status"),
        F.when(size == 3, F.array("raw_record_id")).when((size == 5) | (size < 5) | (size == 6), F.array().cast("array<string>"))
        .when(size == 8, F.array("raw_record_id", "raw_record_id"))
        .when(size == 10, F.array(F.lit("raw-unknown"))).otherwise(F.array("raw_record_id")).alias("singapore_raw_record_ids"),
        review.alias("review"),
        F.lit("catalogue-1").alias("identity_dataset_version"), F.lit("base-1").alias("singapore_regulatory_baseline"),
    )


def rule_identities(spark, d):
    return rules(spark, d).filter("limit_basis is null").select(
        F.concat(F.lit("id-"), "rule_id").alias("ingredient_id"), F.col("substance_name").alias("canonical_name")
    )


_DECISIONS = """dz AS (SELECT 'id-' || rule_id AS id, r.*, limit_value * 10 AS size FROM rules r WHERE side = 'ctl' AND case_label IS NULL),
    dd AS (SELECT *, CASE WHEN size = 5 THEN 'maybe' WHEN size < 5 THEN 'verified_not_represented' ELSE 'linked' END AS status,
       CASE WHEN size = 3 THEN [raw_record_id] WHEN size <= 6 AND size IN (5, 6) OR size < 5 THEN [] WHEN size = 8 THEN [raw_record_id, raw_record_id] WHEN size = 10 THEN ['raw-unknown'] ELSE [raw_record_id] END AS raws FROM dz),
    rejects AS (SELECT id, 'unknown_identity' AS code FROM dd WHERE limit_basis IS NOT NULL
      UNION ALL SELECT id, 'name_mismatch' FROM dd WHERE size = 7 AND limit_basis IS NULL
      UNION ALL SELECT id, 'unsupported_status' FROM dd WHERE size = 5
      UNION ALL SELECT id, 'linked_without_target' FROM dd WHERE status = 'linked' AND len(raws) = 0
      UNION ALL SELECT id, 'target_without_link' FROM dd WHERE status <> 'linked' AND len(raws) > 0
      UNION ALL SELECT id, 'not_reviewed' FROM dd WHERE limit_unit = 'ppm'
      UNION ALL SELECT id, 'invalid_reviewed_at' FROM dd WHERE limit_comparator = 'less_than'
      UNION ALL SELECT id, 'blank_reviewer' FROM dd WHERE required_warning IS NOT NULL)"""


@register("validate_linkage_decisions", oracle("rules", _DECISIONS + " SELECT id AS catalogue_ingredient_id, code FROM rejects"))
def _(spark, d):
    return L.validate_linkage_decisions(decisions(spark, d), rule_identities(spark, d), BINDINGS)


_TARGETS = """nm AS (SELECT id, unnest(raws) AS raw FROM dd), ct AS (SELECT id, raw, count(*) AS n FROM nm GROUP BY ALL),
    jd AS (SELECT c.*, a.act, CASE WHEN n > 1 THEN 'duplicate_target' WHEN a.act IS NULL THEN 'unknown_or_out_of_scope_target' WHEN NOT a.act THEN 'inactive_target' END AS code
           FROM ct c LEFT JOIN (SELECT raw_record_id, bool_and(active) AS act FROM rules WHERE side = 'ctl' GROUP BY 1) a ON a.raw_record_id = c.raw)"""


def hashed_rules(spark, d):
    return rules(spark, d).withColumn("source_hash", F.md5("source_document"))


@register(
    "derive_link_targets",
    oracle(
        "rules",
        f"""{_DECISIONS}, {_TARGETS} SELECT j.id AS catalogue_ingredient_id, j.raw AS raw_record_id, r.rule_id, j.code FROM jd j LEFT JOIN rules r ON r.raw_record_id = j.raw AND r.side = 'ctl' AND j.code IS NULL""",
    ),
)
def _(spark, d):
    targets, errors = L.derive_link_targets(decisions(spark, d), hashed_rules(spark, d))
    good = targets.select("catalogue_ingredient_id", "raw_record_id", "rule_id", F.lit(None).cast("string").alias("code"))
    return good.unionByName(errors.select("catalogue_ingredient_id", "raw_record_id", F.lit(None).cast("string").alias("rule_id"), "code"))


def accepted(spark, d):
    chosen = decisions(spark, d)
    rejected = L.validate_linkage_decisions(chosen, rule_identities(spark, d), BINDINGS).select("catalogue_ingredient_id")
    targets, errors = L.derive_link_targets(chosen, hashed_rules(spark, d))
    return L.accepted_linkages(chosen, rejected.unionByName(errors.select("catalogue_ingredient_id")), "base-1"), targets


_ACCEPTED = f"{_TARGETS}, acc AS (SELECT * FROM dd WHERE id NOT IN (SELECT id FROM rejects) AND id NOT IN (SELECT id FROM jd WHERE code IS NOT NULL))"


@register(
    "accepted_linkages",
    oracle("rules", f"{_DECISIONS}, {_ACCEPTED} SELECT 'eu-sg-link-' || id || '-base-1' AS linkage_id, id AS catalogue_ingredient_id, status FROM acc"),
)
def _(spark, d):
    return accepted(spark, d)[0].select("linkage_id", "catalogue_ingredient_id", "status")


@register(
    "linkage_counts",
    oracle("rules", f"{_DECISIONS}, {_ACCEPTED} SELECT count(*) AS accepted_records, count(*) FILTER (WHERE status = 'linked') AS linked, count(*) FILTER (WHERE status = 'verified_not_represented') AS verified_not_represented, count(*) FILTER (WHERE status = 'unresolved') AS unresolved FROM acc"),
)
def _(spark, d):
    return L.linkage_counts(accepted(spark, d)[0])


@register(
    "linkage_integrity",
    oracle(
        "rules",
        f"""{_DECISIONS}, {_TARGETS}, ht AS (SELECT DISTINCT id FROM jd WHERE code IS NULL)
            SELECT 'unsupported_status' AS code, id AS key FROM dd WHERE size = 5
            UNION ALL SELECT 'not_reviewed', id FROM dd WHERE limit_unit = 'ppm'
            UNION ALL SELECT 'linked_without_target', id FROM dd WHERE status = 'linked' AND id NOT IN (SELECT id FROM ht)
            UNION ALL SELECT 'target_without_link', id FROM dd WHERE status <> 'linked' AND id IN (SELECT id FROM ht)""",
    ),
)
def _(spark, d):
    """All decisions as if they had been accepted unseen."""
    chosen = decisions(spark, d)
    targets, _errors = L.derive_link_targets(chosen, hashed_rules(spark, d))
    return L.linkage_integrity(chosen, targets, BINDINGS, L.linkage_counts(chosen))


@register(
    "linkage_staleness",
    oracle(
        "rules",
        f"""{_DECISIONS}, {_ACCEPTED},
            st AS (SELECT a.id, CAST((a.limit_stage = 'after_mixing') AS INT) + coalesce((SELECT count(*) FROM rules r WHERE r.raw_record_id = a.raws[1] AND r.side = 'ctl' AND r.other_conditions IS NOT NULL AND a.status = 'linked'), 0) AS n, a.status FROM acc a)
            SELECT 'eu-sg-link-' || id || '-base-1' AS linkage_id, status AS accepted_status, CAST(n AS BIGINT) AS stale_reasons, CASE WHEN n > 0 THEN 'unresolved' ELSE status END AS effective_status,
              CASE WHEN n > 0 THEN 'linkage_not_valid_for_active_baseline' END AS reason FROM st""",
    ),
)
def _(spark, d):
    """Names of late-stage entries and texts of conditional rules have moved on since acceptance."""
    links, targets = accepted(spark, d)
    now = rules(spark, d)
    identities = now.select(
        F.concat(F.lit("id-"), "rule_id").alias("ingredient_id"),
        F.when(F.col("limit_stage") == "after_mixing", F.concat("substance_name", F.lit(" new"))).otherwise(F.col("substance_name")).alias("canonical_name"),
    )
    changed = hashed_rules(spark, d).withColumn(
        "source_hash", F.when(F.col("other_conditions").isNotNull(), "other").otherwise(F.col("source_hash"))
    )
    assessed, _reasons = L.linkage_staleness(links, targets, identities, changed, BINDINGS)
    return assessed.select("linkage_id", "accepted_status", "stale_reasons", "effective_status", "reason")
