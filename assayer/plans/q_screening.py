"""Registered queries of lookup, comparison, resolution, screening and formulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import constants as K
from assayer.functions import labels
from assayer.operators import rules as R
from assayer.operators import formulation, lookup, resolve, screen, xref
from assayer.plans.adapters import entity, oracle, stage, table
from assayer.plans.oracle_parts import cas_ok, fold
from assayer.session import settle

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


def substances(spark, d):
    return entity(spark, d, "substances")


def ingredients(spark, d):
    return entity(spark, d, "ingredients")


def snapshot(spark, d):
    return stage(
        spark, d, "snapshot", lambda: formulation.prepared_snapshot(rules(spark, d), substances(spark, d))
    )


def requests(spark, d):
    """Written once: a later ``distinct`` of their keys would otherwise replace theirs, and check digits be computed per submitted row."""
    pairs = lambda: settle(ingredients(spark, d).select("name", "cas_number").distinct(), "submitted-pairs")
    return stage(spark, d, "requests", lambda: settle(resolve.identity_requests(pairs()), "identity-requests"))


def evaluated(spark, d):
    return stage(
        spark, d, "evaluated",
        lambda: formulation.evaluated_requests(ingredients(spark, d), snapshot(spark, d), entity(spark, d, "catalogue")),
    )


def results(spark, d):
    return screen.screen_ingredients(ingredients(spark, d), evaluated(spark, d))


# --- comparison of the two snapshots -------------------------------------------------------------


@register(
    "group_rules_by_reference",
    oracle(
        "o_sides",
        """n AS (SELECT *, row_number() OVER (PARTITION BY mapping, ref, label, adv ORDER BY rule_id) - 1 AS case_number FROM o_sides)
           SELECT mapping AS regulatory_mapping, ref AS reference_key, label AS case_label, case_number,
                  min(rule_id) FILTER (WHERE adv) AS acd_rule_id, min(rule_id) FILTER (WHERE NOT adv) AS singapore_rule_id
           FROM n GROUP BY ALL""",
    ),
)
def _(spark, d):
    return xref.group_rules_by_reference(rules(spark, d)).select(
        "regulatory_mapping", "reference_key", "case_label", "case_number", "acd_rule_id", "singapore_rule_id"
    )


@register(
    "compare_snapshots",
    oracle(
        "o_status o_candidates",
        """SELECT xref_id AS cross_reference_id, mapping AS regulatory_mapping, reference_number, n_acd AS acd_rules, n_sg AS singapore_rules,
                  CASE WHEN n_acd > 0 AND n_sg > 0 THEN 'reference_number' ELSE 'unmatched' END AS match_basis,
                  status AS comparison_status, CASE WHEN status = 'changed' THEN changed ELSE '' END AS changed_fields,
                  CAST(coalesce(candidates, 0) AS BIGINT) AS candidate_count,
                  status <> 'aligned' AS professional_review_required,
                  CASE status WHEN 'aligned' THEN '' WHEN 'changed' THEN 'source_wording_or_regulatory_field_differs'
                    WHEN 'acd_only' THEN 'no_current_singapore_reference_number_match' || CASE WHEN candidates > 0 THEN '|same_normalized_substance_name_found_under_different_reference' ELSE '' END
                    WHEN 'singapore_only' THEN 'no_acd_2026_1_reference_number_match' || CASE WHEN candidates > 0 THEN '|same_normalized_substance_name_found_under_different_reference' ELSE '' END
                    ELSE CASE WHEN regexp_full_match(reference_number, '(?i)A?[0-9]+[a-z]?\\s*(?:-|to)\\s*A?[0-9]+[a-z]?')
                              THEN 'ranged_reference_prevents_unique_entry_correspondence'
                              ELSE 'normalized_case_structure_differs_between_sources' END END AS review_reasons
           FROM o_status LEFT JOIN (SELECT mapping AS m, ref AS r, sum(candidates) AS candidates FROM o_candidates GROUP BY ALL) ON m = mapping AND r = ref""",
    ),
)
def _(spark, d):
    return xref.compare_snapshots(rules(spark, d)).select(
        "cross_reference_id", "regulatory_mapping", "reference_number", "acd_rules", "singapore_rules", "match_basis",
        "comparison_status", F.array_join("changed_fields", ",").alias("changed_fields"), "candidate_count",
        "professional_review_required", pipe("review_reasons").alias("review_reasons"),
    ).orderBy("regulatory_mapping", F.rlike("reference_number", F.lit("^[0-9]")).desc(), "reference_number")


@register(
    "field_differences",
    oracle(
        "o_status",
        f"""SELECT s.xref_id AS cross_reference_id, x.field, x.text AS acd, y.text AS singapore
            FROM o_status s JOIN o_texts x ON x.mapping = s.mapping AND x.ref = s.ref AND x.adv
            JOIN o_texts y ON y.mapping = s.mapping AND y.ref = s.ref AND NOT y.adv AND y.field = x.field
            WHERE s.status = 'changed' AND {fold('x.text')} <> {fold('y.text')}""",
    ),
)
def _(spark, d):
    r = rules(spark, d)
    return xref.field_differences(r, xref.compare_snapshots(r))


@register(
    "rename_candidates",
    oracle(
        "o_status o_candidates",
        """SELECT c.mapping AS regulatory_mapping, c.ref AS reference_key, c.nk AS name_key, c.candidates AS candidate_count,
                  CASE s.status WHEN 'acd_only' THEN 'singapore:' ELSE 'acd:' END || c.first_ref AS first_candidate
           FROM o_candidates c JOIN o_status s ON s.mapping = c.mapping AND s.ref = c.ref""",
    ),
)
def _(spark, d):
    r = rules(spark, d)
    return xref.rename_candidates(xref.compare_snapshots(r), r)


@register(
    "rename_candidate_rows",
    oracle(
        "o_status",
        f"""SELECT DISTINCT s.mapping AS regulatory_mapping, s.ref AS reference_key, {fold('n.substance_name')} AS name_key, CASE s.status WHEN 'acd_only' THEN 'singapore:' ELSE 'acd:' END || o.ref AS candidate
            FROM o_status s JOIN o_sides n ON n.mapping = s.mapping AND n.ref = s.ref
            JOIN o_sides o ON o.mapping = s.mapping AND {fold('o.substance_name')} = {fold('n.substance_name')} AND o.active AND o.adv = (s.status = 'singapore_only')
            WHERE s.status IN ('acd_only', 'singapore_only')""",
    ),
)
def _(spark, d):
    r = rules(spark, d)
    return xref.rename_candidate_rows(xref.compare_snapshots(r), r)


_CASES = f"""n AS (SELECT *, row_number() OVER (PARTITION BY mapping, ref, label, adv, field ORDER BY rule_id) - 1 AS case_number FROM o_values),
    c AS (SELECT DISTINCT s.xref_id, s.mapping, s.ref, x.field FROM o_status s JOIN o_texts x ON x.mapping = s.mapping AND x.ref = s.ref AND x.adv
          JOIN o_texts y ON y.mapping = s.mapping AND y.ref = s.ref AND NOT y.adv AND y.field = x.field WHERE s.status = 'changed' AND {fold('x.text')} <> {fold('y.text')})
    SELECT c.xref_id AS cross_reference_id, c.field, a.label AS case_label, a.case_number, a.rule_id AS acd_rule_id, b.rule_id AS singapore_rule_id, a.value AS acd, b.value AS singapore,
      {fold('a.value')} <> {fold('b.value')} AS differs
    FROM c JOIN n a ON a.mapping = c.mapping AND a.ref = c.ref AND a.field = c.field AND a.adv
    JOIN n b ON b.mapping = c.mapping AND b.ref = c.ref AND b.field = c.field AND NOT b.adv AND b.label = a.label AND b.case_number = a.case_number"""


@register("case_differences", oracle("o_status", _CASES))
def _(spark, d):
    r = rules(spark, d)
    return xref.case_differences(r, xref.compare_snapshots(r))


def _without_labels(sql: str) -> str:
    """The SQL over rules whose cases carry no label, so that a reference repeats its parent case."""
    return sql.replace("coalesce(case_label, 'parent') AS label", "'parent' AS label")


def unlabelled(spark, d):
    return rules(spark, d).withColumn("case_label", F.lit(None).cast("string"))


@register("compare_repeated_cases", _without_labels(oracle("o_status", "SELECT xref_id AS cross_reference_id, n_acd AS acd_rules, n_sg AS singapore_rules, status AS comparison_status, CASE WHEN status = 'changed' THEN changed ELSE '' END AS changed_fields FROM o_status")))
def _(spark, d):
    return xref.compare_snapshots(unlabelled(spark, d)).select(
        "cross_reference_id", "acd_rules", "singapore_rules", "comparison_status", F.array_join("changed_fields", ",").alias("changed_fields")
    )


@register("repeated_case_differences", _without_labels(oracle("o_status", _CASES)))
def _(spark, d):
    r = unlabelled(spark, d)
    return xref.case_differences(r, xref.compare_snapshots(r))


@register(
    "snapshot_bridge",
    oracle("o_bridge", "SELECT adv_id AS advisory_substance_id, ctl_id AS controlling_substance_id, status AS comparison_status FROM o_bridge"),
)
def _(spark, d):
    return snapshot(spark, d)["bridge"]


_NUM = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"


@register(
    "comparison_rows",
    oracle(
        "o_status",
        f"""d AS (SELECT s.xref_id, s.mapping, s.ref, x.field, x.text AS a, y.text AS c
              FROM o_status s JOIN o_texts x ON x.mapping = s.mapping AND x.ref = s.ref AND x.adv
              JOIN o_texts y ON y.mapping = s.mapping AND y.ref = s.ref AND NOT y.adv AND y.field = x.field
              WHERE s.status = 'changed' AND {fold('x.text')} <> {fold('y.text')}),
            p AS (SELECT *, regexp_replace(a, '^\\[parent\\]\\s?', '') AS pa, regexp_replace(c, '^\\[parent\\]\\s?', '') AS pc FROM d),
            q AS (SELECT *, field = 'concentration' AND starts_with(pa, '{{') AND starts_with(pc, '{{') AS four,
                    CASE WHEN field = 'concentration' AND starts_with(pa, '{{') THEN CAST(pa AS JSON) END AS ja,
                    CASE WHEN field = 'concentration' AND starts_with(pc, '{{') THEN CAST(pc AS JSON) END AS jc FROM p),
            v AS (SELECT xref_id, [struct_pack(f := 'Maximum concentration', k := 'value'), struct_pack(f := 'Comparator', k := 'comparator'),
                      struct_pack(f := 'Concentration basis', k := 'basis'), struct_pack(f := 'Preparation stage', k := 'preparation_stage')] AS t, ja, jc FROM q WHERE four),
            w AS (SELECT xref_id, unnest(t) AS t, ja, jc FROM v),
            z AS (SELECT xref_id, t.f AS field, t.k AS k, json_extract_string(ja, '$.' || t.k) AS a, json_extract_string(jc, '$.' || t.k) AS c,
                      json_extract_string(ja, '$.unit') AS ua, json_extract_string(jc, '$.unit') AS uc FROM w)
            SELECT xref_id AS cross_reference_id, field,
              CASE k WHEN 'value' THEN {_NUM.format('a')} || CASE WHEN ua = 'percent' THEN '%' ELSE ' ' || ua END
                WHEN 'basis' THEN coalesce(a, 'No specific basis')
                WHEN 'comparator' THEN CASE a WHEN 'less_than_or_equal' THEN 'At most' WHEN 'less_than' THEN 'Less than' ELSE 'Greater than' END
                ELSE CASE a WHEN 'finished_product' THEN 'Finished product' WHEN 'after_mixing' THEN 'After mixing for use' ELSE 'Unspecified' END END AS acd,
              CASE k WHEN 'value' THEN {_NUM.format('c')} || CASE WHEN uc = 'percent' THEN '%' ELSE ' ' || uc END
                WHEN 'basis' THEN coalesce(c, 'No specific basis')
                WHEN 'comparator' THEN CASE c WHEN 'less_than_or_equal' THEN 'At most' WHEN 'less_than' THEN 'Less than' ELSE 'Greater than' END
                ELSE CASE c WHEN 'finished_product' THEN 'Finished product' WHEN 'after_mixing' THEN 'After mixing for use' ELSE 'Unspecified' END END AS singapore
            FROM z
            UNION ALL
            SELECT xref_id, CASE field WHEN 'substance_name' THEN 'Source substance wording' WHEN 'product_context' THEN 'Product context'
                     WHEN 'other_conditions' THEN 'Other requirements' WHEN 'required_warning' THEN 'Required warning' ELSE 'Concentration' END,
                   CASE WHEN pa = '' THEN '—' ELSE pa END, CASE WHEN pc = '' THEN '—' ELSE pc END
            FROM q WHERE NOT four""",
    ),
)
def _(spark, d):
    r = rules(spark, d)
    return xref.comparison_rows(xref.field_differences(r, xref.compare_snapshots(r)))


# --- lookup views --------------------------------------------------------------------------------


@register("substance_lookup", oracle("o_lookup", "SELECT * FROM o_lookup"))
def _(spark, d):
    return lookup.substance_lookup(substances(spark, d))


@register(
    "rule_subsets",
    oracle(
        "rules",
        """SELECT rule_id, substance_id, CASE WHEN active AND normalization_status = 'normalized' THEN 'executable'
                  WHEN NOT active OR normalization_status = 'inactive_source_entry' THEN 'inactive' ELSE 'withheld' END AS subset
           FROM rules WHERE side = 'ctl'""",
    ),
)
def _(spark, d):
    return lookup.rule_subsets(rules(spark, d)).select("rule_id", "substance_id", "subset")


@register(
    "rule_subset_counts",
    oracle(
        "rules",
        """SELECT substance_id, count(*) FILTER (WHERE active AND normalization_status = 'normalized') AS executable_rules,
                  count(*) FILTER (WHERE NOT active OR normalization_status = 'inactive_source_entry') AS inactive_rules, count(*) AS rules
           FROM rules WHERE side = 'ctl' GROUP BY 1""",
    ),
)
def _(spark, d):
    return lookup.subset_counts(rules(spark, d))


@register(
    "rules_by_reference",
    oracle("rules", "SELECT regulatory_section, lower(reference_number) AS reference_key, rule_id, raw_record_id, active FROM rules WHERE side = 'ctl'"),
)
def _(spark, d):
    return lookup.rules_by_reference(rules(spark, d))


@register(
    "product_contexts",
    oracle("o_contexts", "SELECT context_key, product_context, CAST(row_number() OVER (ORDER BY lower(product_context)) - 1 AS INT) AS option_index FROM o_contexts"),
)
def _(spark, d):
    return lookup.context_options(lookup.product_contexts(rules(spark, d)))


# --- identity ------------------------------------------------------------------------------------


@register("match_by_name", oracle("o_matches", "SELECT * FROM o_matches WHERE key_type = 'name'"))
def _(spark, d):
    return resolve.match_by_name(requests(spark, d), snapshot(spark, d)["lookup"])


@register("match_by_identifier", oracle("o_matches", "SELECT * FROM o_matches WHERE key_type = 'cas'"))
def _(spark, d):
    return resolve.match_by_identifier(requests(spark, d), snapshot(spark, d)["lookup"])


@register("bridge_matches", oracle("o_reach", "SELECT * FROM o_reach"))
def _(spark, d):
    views, req = snapshot(spark, d), requests(spark, d)
    matches = resolve.match_by_name(req, views["lookup"]).unionByName(resolve.match_by_identifier(req, views["lookup"]))
    return resolve.bridge_matches(matches, views["bridge"])


@register(
    "merge_candidates",
    oracle(
        "o_reach",
        """SELECT key_type, key, substance_id, string_agg(DISTINCT method, '|' ORDER BY method) AS match_methods,
                  coalesce(string_agg(DISTINCT status, '|' ORDER BY status), '') AS cross_reference_statuses, bool_or(direct) AS direct
           FROM o_reach GROUP BY ALL""",
    ),
)
def _(spark, d):
    views, req = snapshot(spark, d), requests(spark, d)
    _, candidates = resolve.candidates_for(req, views["lookup"], views["bridge"])
    return candidates.withColumn("match_methods", pipe("match_methods")).withColumn(
        "cross_reference_statuses", pipe("cross_reference_statuses")
    )


def _identity_before_catalogue(spark, d):
    views, req = snapshot(spark, d), requests(spark, d)
    matches, candidates = resolve.candidates_for(req, views["lookup"], views["bridge"])
    candidates = settle(candidates, "candidates")
    summary = settle(resolve.candidate_summary(candidates, matches), "candidate-summary")
    return resolve.resolve_identity(req, summary, resolve.common_candidates(req, summary, candidates))


_IDENTITY = ["name", "cas_number", "status", "substance_id", "match_methods", "identity_source_type", "reasons"]


def _identity_columns(df, *extra):
    return df.select(
        "name", "cas_number", "status", "substance_id", pipe("match_methods").alias("match_methods"),
        "identity_source_type", pipe("reasons").alias("reasons"), *extra,
    )


_IDENTITY_SQL = """name, cas_number, status, substance_id, array_to_string(match_methods, '|') AS match_methods,
    source_type AS identity_source_type, array_to_string(reasons, '|') AS reasons"""


@register(
    "resolve_identity",
    oracle(
        "o_resolved",
        f"SELECT {_IDENTITY_SQL}, len(list_distinct(list_concat(nids, cids))) AS controlling_candidates, n_adv OR c_adv AS has_advisory_candidate FROM o_resolved",
    ),
)
def _(spark, d):
    return _identity_columns(
        _identity_before_catalogue(spark, d), "controlling_candidates", "has_advisory_candidate"
    )


@register(
    "resolution_source",
    oracle("o_resolved", "SELECT status, source_type AS identity_source_type, count(*) AS requests FROM o_resolved GROUP BY ALL"),
)
def _(spark, d):
    return _identity_before_catalogue(spark, d).groupBy("status", "identity_source_type").agg(F.count("*").alias("requests"))


@register("catalogue_fallback", oracle("o_identity", f"SELECT {_IDENTITY_SQL}, catalogue_ingredient_id, catalogue_name FROM o_identity"))
def _(spark, d):
    resolved = resolve.catalogue_fallback(_identity_before_catalogue(spark, d), entity(spark, d, "catalogue"))
    return _identity_columns(resolved, "catalogue_ingredient_id", "catalogue_name")


@register(
    "degraded_catalogue",
    oracle(
        "o_resolved",
        """SELECT name, cas_number, CASE WHEN status = 'unresolved' AND nk <> '' THEN 'review_required' ELSE status END AS status, substance_id,
                  array_to_string(match_methods, '|') AS match_methods, source_type AS identity_source_type,
                  CASE WHEN status = 'unresolved' AND nk <> '' THEN 'ingredient_catalogue_unavailable_identity_verification_withheld'
                       ELSE array_to_string(reasons, '|') END AS reasons FROM o_resolved""",
    ),
)
def _(spark, d):
    return _identity_columns(resolve.degraded_catalogue(_identity_before_catalogue(spark, d), "catalogue hash mismatch"))


# --- screening -----------------------------------------------------------------------------------


@register("applicable_rules", oracle("o_applicable", "SELECT formulation_id, row_number, rule_id FROM o_applicable"))
def _(spark, d):
    r = results(spark, d)
    return r.select("formulation_id", "row_number", F.explode(
        F.array_union(F.transform("evaluations", lambda e: e["rule_id"]), F.col("inactive_rules"))
    ).alias("rule_id"))


_STATUS_SQL = """CASE WHEN branch IN ('context_missing', 'amount_missing') THEN 'withheld_information_missing'
    WHEN branch IN ('prohibited', 'within', 'exceeded') THEN 'deterministic'
    WHEN branch = 'other_context' THEN 'not_applicable_to_submitted_context' ELSE 'withheld_professional_review' END"""
_FINDING_SQL = """CASE branch WHEN 'prohibited' THEN 'prohibited_substance_identified' WHEN 'within' THEN 'restriction_within_limit'
    WHEN 'exceeded' THEN 'restriction_exceeded' END"""


@register(
    "evaluate_rules",
    oracle(
        "o_evaluations",
        f"""SELECT formulation_id, row_number, rule_id, {_STATUS_SQL} AS evaluation_status, {_FINDING_SQL} AS finding,
                   array_to_string(reasons, '|') AS reasons FROM o_evaluations WHERE branch <> 'inactive'""",
    ),
)
def _(spark, d):
    return screen.rule_evaluations(results(spark, d)).select(
        "formulation_id", "row_number", "rule_id", "evaluation_status", "finding", pipe("reasons").alias("reasons")
    )


@register(
    "limit_comparison",
    oracle(
        "o_evaluations",
        f"""SELECT formulation_id, row_number, rule_id, CASE WHEN branch = 'incompatible' THEN mismatch ELSE '' END AS incompatible, {_FINDING_SQL} AS finding
            FROM o_evaluations WHERE branch IN ('incompatible', 'within', 'exceeded')""",
    ),
)
def _(spark, d):
    e = screen.rule_evaluations(results(spark, d)).filter(F.col("branch").isin("incompatible", "compare"))
    return e.select(
        "formulation_id", "row_number", "rule_id",
        F.when(F.col("branch") == "incompatible", F.regexp_extract(F.get("reasons", F.lit(0)), "incompatible ([^;]*);", 1))
        .otherwise("").alias("incompatible"),
        "finding",
    )


_RESULT_SQL = """formulation_id, row_number, status, primary_finding, review_required, review_type,
    array_to_string(review_reasons, '|') AS review_reasons,
    array_to_string(list_filter([CASE WHEN has_prohibited THEN 'prohibited_substance_identified' END, CASE WHEN has_exceeded THEN 'restriction_exceeded' END,
      CASE WHEN has_within THEN 'restriction_within_limit' END], lambda x: x IS NOT NULL), '|') AS confirmed_findings"""


@register("screen_ingredients", oracle("o_results", f"SELECT {_RESULT_SQL} FROM o_results"))
def _(spark, d):
    return results(spark, d).select(
        "formulation_id", "row_number", "status", "primary_finding", "review_required", "review_type",
        pipe("review_reasons").alias("review_reasons"),
        F.array_join(F.array_sort("confirmed_findings"), "|").alias("confirmed_findings"),
    )


@register(
    "rule_evidence",
    oracle(
        "o_status",
        """p AS (SELECT * FROM (VALUES ('Third Schedule Part I', 'sg-regulation-6-1'), ('Third Schedule Part I', 'sg-regulation-6-7'),
                ('Third Schedule Part II', 'sg-regulation-6-2'), ('Third Schedule Part II', 'sg-regulation-6-7')) t(section, provision))
           SELECT rule_id AS owner, 'provision' AS kind, provision AS item, CAST(NULL AS VARCHAR) AS status FROM rules JOIN p ON section = regulatory_section
           UNION ALL SELECT x.rule_id, 'cross_reference', s.xref_id, s.status FROM o_sides x JOIN o_status s ON s.mapping = x.mapping AND s.ref = x.ref WHERE NOT x.adv
           UNION ALL SELECT s.xref_id, 'counterpart', x.rule_id, NULL FROM o_sides x JOIN o_status s ON s.mapping = x.mapping AND s.ref = x.ref WHERE x.adv""",
    ),
)
def _(spark, d):
    r = rules(spark, d)
    # the snapshot's provisions are the ones its sections cite
    provisions = r.select(
        F.explode(F.element_at(F.create_map(*[
            x for s, ids in K.SECTION_PROVISIONS.items() for x in (F.lit(s), F.array(*[F.lit(i) for i in ids]))
        ]), F.col("regulatory_section"))).alias("provision_id")
    ).distinct()
    return screen.rule_evidence(r, snapshot(spark, d)["links"], provisions)


@register("evidence_record", oracle("rules", "SELECT rule_id, source_document, regulatory_section, reference_number, substance_name, product_context, other_conditions, required_warning, source_text, normalization_status, raw_record_id FROM rules"))
def _(spark, d):
    shown = screen.evidence_record(rules(spark, d))
    return shown.select("rule_id", "source_document", "regulatory_section", "reference_number", "substance_name", "product_context", "other_conditions", "required_warning", "source_text", "normalization_status", "raw_record_id")


def raw_rows(spark, d):
    """Raw records; those of restricted sections have a fragment per line of their text, the others stand for themselves."""
    lines = F.split("source_text", "\n")
    pieces = F.transform(lines, lambda line, i: F.struct((F.col("source_page") + i).alias("source_page"), line.alias("original_row_text")))
    restricted = F.col("section").isin("Annex III Part 1", "Third Schedule Part II")
    return entity(spark, d, "records").select(
        "raw_record_id", "source_text", F.array("source_page").alias("pages"), F.when(restricted, pieces).alias("fragments")
    )


@register(
    "evidence_fragments",
    oracle(
        "rules records",
        """l AS (SELECT raw_record_id, section, source_text, source_page, string_split(source_text, chr(10)) AS lines FROM records),
           f AS (SELECT raw_record_id, CAST(i - 1 AS INT) AS position, CAST(json_object('raw_record_id', raw_record_id, 'source_page', source_page + i - 1, 'original_row_text', lines[i]) AS VARCHAR) AS fragment
             FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l WHERE section IN ('Annex III Part 1', 'Third Schedule Part II'))
             UNION ALL SELECT raw_record_id, 0, CAST(json_object('raw_record_id', raw_record_id, 'pages', [source_page], 'source_text', source_text) AS VARCHAR)
             FROM l WHERE section NOT IN ('Annex III Part 1', 'Third Schedule Part II'))
           SELECT rule_id, position, fragment FROM rules JOIN f USING (raw_record_id)""",
    ),
)
def _(spark, d):
    return screen.evidence_fragments(rules(spark, d), raw_rows(spark, d))


_PROVISIONS = """v AS (SELECT * FROM (VALUES ('sg-regulation-6-1', 'doc-1', 'first'), ('sg-regulation-6-2', 'doc-2', 'second'), ('sg-regulation-6-7', 'doc-1', 'third')) t(provision_id, source_document, source_text)),
    h AS (SELECT 'doc-' || (1 + CAST(starts_with(p_type, 'PROMO') AS INT)) AS source_document, md5(CAST(sum(p_partkey) AS VARCHAR)) AS source_hash, CAST(max(p_size) AS VARCHAR) AS source_version FROM part GROUP BY 1),
    m AS (SELECT * FROM (VALUES ('sg-regulation-6-1', 'Annex II Part 1'), ('sg-regulation-6-2', 'Annex III Part 1'), ('sg-regulation-6-2', 'Appendix I')) t(provision_id, corresponds_to)),
    ps AS (SELECT provision_id, source_document, source_text, source_version, source_hash, 'https://x.example/' || source_document AS source_url, '2025-12-01' AS effective_date, '2026-01-01' AS retrieval_date, corresponds_to
      FROM v JOIN h USING (source_document) LEFT JOIN m USING (provision_id))"""


def provisions(spark, d):
    """Provisions of two documents whose hash and revision come from the parts, and what they answer to in structure."""
    text = spark.createDataFrame(
        [("sg-regulation-6-1", "doc-1", "first"), ("sg-regulation-6-2", "doc-2", "second"), ("sg-regulation-6-7", "doc-1", "third")],
        "provision_id string, source_document string, source_text string",
    )
    document = F.concat(F.lit("doc-"), (1 + F.col("p_type").startswith("PROMO").cast("int")).cast("string"))
    sources = table(spark, d, "part").groupBy(document.alias("source_document")).agg(
        F.md5(F.sum("p_partkey").cast("string")).alias("sha256"), F.max("p_size").cast("string").alias("document_revision")
    ).select(
        "*", F.concat(F.lit("https://x.example/"), "source_document").alias("source_url"), F.lit("2025-12-01").alias("effective_date"), F.lit("2026-01-01").alias("retrieval_date")
    )
    mappings = spark.createDataFrame(
        [("sg-regulation-6-1", "Annex II Part 1"), ("sg-regulation-6-2", "Annex III Part 1"), ("sg-regulation-6-2", "Appendix I")], "provision_id string, corresponds_to string"
    )
    return R.provision_snapshot(text, sources, mappings)


@register("provision_snapshot", f"WITH {_PROVISIONS} SELECT * FROM ps")
def _(spark, d):
    return provisions(spark, d)


@register(
    "evidence_provisions",
    oracle(
        "rules",
        _PROVISIONS + """, c AS (SELECT * FROM (VALUES ('Third Schedule Part I', 'sg-regulation-6-1', 0), ('Third Schedule Part I', 'sg-regulation-6-7', 1),
                ('Third Schedule Part II', 'sg-regulation-6-2', 0), ('Third Schedule Part II', 'sg-regulation-6-7', 1)) t(section, provision_id, position))
           SELECT rule_id, position, ps.* FROM rules JOIN c ON section = regulatory_section JOIN ps USING (provision_id)""",
    ),
)
def _(spark, d):
    return screen.evidence_provisions(rules(spark, d), provisions(spark, d))


@register(
    "inactive_evidence",
    oracle("o_evaluations", "SELECT formulation_id, row_number, rule_id, branch = 'inactive_open' AS needs_review FROM o_evaluations WHERE branch LIKE 'inactive%'"),
)
def _(spark, d):
    return screen.inactive_evidence(results(spark, d))


@register(
    "supporting_evaluations",
    oracle(
        "o_results",
        f"""f AS (SELECT formulation_id, row_number, primary_finding,
                  CASE WHEN has_prohibited THEN 'prohibited' WHEN has_exceeded THEN 'exceeded' WHEN has_within THEN 'within' END AS b FROM o_results)
            SELECT e.formulation_id, e.row_number, f.primary_finding, e.rule_id, {_FINDING_SQL} AS finding, 'deterministic' AS evaluation_status
            FROM o_evaluations e JOIN f ON f.formulation_id = e.formulation_id AND f.row_number = e.row_number AND e.branch = f.b""",
    ),
)
def _(spark, d):
    return screen.supporting_evaluations(results(spark, d))


_CUT = "CASE WHEN strpos(lower({0}), ' (except ') > 0 THEN substr({0}, 1, strpos(lower({0}), ' (except ') - 1) ELSE {0} END"


@register(
    "finding_display_name",
    oracle(
        "o_results",
        f"""n AS (SELECT r.*, coalesce(CASE WHEN has_prohibited THEN prohibited_rule.n WHEN has_exceeded THEN exceeded_rule.n WHEN has_within THEN within_rule.n END,
                       s.original_substance_name, r.catalogue_name) AS backed
                FROM o_results r LEFT JOIN substances s ON s.substance_id = r.substance_id)
            SELECT formulation_id, row_number, coalesce({_CUT.format('backed')}, name) AS display_name FROM n""",
    ),
)
def _(spark, d):
    return screen.finding_display_name(results(spark, d), substances(spark, d))


# --- formulations --------------------------------------------------------------------------------


def formulations(spark, d):
    """One formulation per order; the priority is its context and some names are blank."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("formulation_id"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("formulation_name"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("product_context"),
    )


_INVALID = f"""SELECT formulation_id, row_number, 'blank_name' AS code FROM ingredients WHERE coalesce(trim(name), '') = ''
            UNION ALL SELECT formulation_id, row_number, 'invalid_cas_number' FROM ingredients
              WHERE cas_number IS NOT NULL AND NOT (regexp_full_match(cas_number, '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]') AND {cas_ok('cas_number')})
            UNION ALL SELECT formulation_id, row_number, 'percent_above_100' FROM ingredients WHERE unit = 'percent' AND value > 100
            UNION ALL SELECT formulation_id, row_number, 'unknown_basis' FROM ingredients WHERE value IS NOT NULL AND basis NOT IN ('NH3', 'free base', 'zinc', 'sulphate', 'hydrochloride', 'tetrahydrochloride')
            UNION ALL SELECT o_orderkey, NULL, 'blank_formulation_name' FROM orders WHERE o_orderstatus = 'P'
            UNION ALL SELECT o_orderkey, NULL, 'no_ingredients' FROM orders WHERE o_orderkey NOT IN (SELECT formulation_id FROM ingredients)"""
_UNKNOWN_CONTEXT = """SELECT o_orderkey AS formulation_id, o_orderpriority AS product_context FROM orders
           WHERE o_orderpriority <> '4-NOT SPECIFIED' AND lower(o_orderpriority) NOT IN (SELECT context_key FROM o_contexts)"""


@register(
    "validate_formulations",
    oracle(
        "ingredients",
        _INVALID,
    ),
)
def _(spark, d):
    return formulation.validate_formulations(formulations(spark, d), ingredients(spark, d))


@register(
    "validate_contexts",
    oracle(
        "o_contexts",
        _UNKNOWN_CONTEXT,
    ),
)
def _(spark, d):
    return formulation.validate_contexts(formulations(spark, d), lookup.product_contexts(rules(spark, d)))


def short_ingredients(spark, d):
    """Submitted rows reduced to family name and unit, so that repeats occur."""
    rows = ingredients(spark, d)
    return rows.withColumn("name", F.regexp_extract("name", r"(?i)(bolt|gear|ring|rod|widget|plate|anvil|gizmo)", 1)).withColumn(
        "cas_number", F.lit(None).cast("string")
    )


_DUP = f"""s AS (SELECT formulation_id, row_number, lower(regexp_extract(name, '(?i)(bolt|gear|ring|rod|widget|plate|anvil|gizmo)', 1)) AS k, value, unit, basis, preparation_stage FROM ingredients),
    t AS (SELECT formulation_id, coalesce(k, '') AS k, value, unit, basis, preparation_stage, row_number,
           count(*) OVER w AS n, min(row_number) OVER w AS first_row FROM s
           WINDOW w AS (PARTITION BY formulation_id, coalesce(k, ''), value, unit, basis, preparation_stage))"""


@register("duplicate_rows", oracle("ingredients", _DUP + " SELECT formulation_id, first_row, row_number FROM t WHERE n > 1"))
def _(spark, d):
    return formulation.duplicate_rows(short_ingredients(spark, d))


_SUMMARY = """count(*) AS ingredients_submitted,
    count(*) FILTER (WHERE primary_finding = 'prohibited_substance_identified') AS prohibited_substance_identified,
    count(*) FILTER (WHERE primary_finding = 'restriction_exceeded') AS restriction_exceeded,
    count(*) FILTER (WHERE primary_finding = 'restriction_within_limit') AS restriction_within_limit,
    count(*) FILTER (WHERE primary_finding = 'professional_review_required') AS professional_review_required,
    count(*) FILTER (WHERE primary_finding = 'information_missing') AS information_missing,
    count(*) FILTER (WHERE primary_finding = 'identity_unresolved') AS identity_unresolved,
    count(*) FILTER (WHERE primary_finding = 'no_issue_identified_within_scoped_rules') AS no_issue_identified_within_scoped_rules,
    count(*) FILTER (WHERE review_required) AS total_requiring_review,
    count(*) FILTER (WHERE primary_finding = 'identity_unresolved') AS total_unresolved_identities,
    count(*) FILTER (WHERE primary_finding IN ('prohibited_substance_identified', 'restriction_exceeded', 'restriction_within_limit')) AS deterministic_findings"""


@register(
    "formulation_summary",
    oracle(
        "o_results",
        f"""{_DUP}, g AS (SELECT formulation_id AS f, count(*) AS n FROM t WHERE n > 1 AND row_number = first_row GROUP BY 1),
            c AS (SELECT formulation_id, {_SUMMARY} FROM o_results GROUP BY 1)
            SELECT c.*, coalesce(g.n, 0) AS duplicate_row_groups FROM c LEFT JOIN g ON g.f = c.formulation_id""",
    ),
)
def _(spark, d):
    return formulation.formulation_summary(results(spark, d), formulation.duplicate_rows(short_ingredients(spark, d)))


def screened(spark, d):
    """The whole job without shared stages below the entities."""
    return formulation.screen_formulations(
        ingredients(spark, d), rules(spark, d), substances(spark, d), entity(spark, d, "catalogue"), formulations=formulations(spark, d)
    )


@register(
    "screen_formulations",
    oracle(
        "o_results ingredients o_contexts",
        f"""invalid AS ({_INVALID}), unknown AS ({_UNKNOWN_CONTEXT})
           SELECT product_context, status, primary_finding, review_type, source_type AS identity_source_type,
                  array_to_string(match_methods, '|') AS match_methods, count(*) AS ingredient_rows, count(DISTINCT formulation_id) AS formulations
           FROM o_results
           WHERE formulation_id NOT IN (SELECT formulation_id FROM invalid) AND formulation_id NOT IN (SELECT formulation_id FROM unknown) GROUP BY ALL""",
    ),
)
def _(spark, d):
    return (
        screened(spark, d)
        .groupBy("product_context", "status", "primary_finding", "review_type", "identity_source_type", pipe("match_methods").alias("match_methods"))
        .agg(F.count("*").alias("ingredient_rows"), F.countDistinct("formulation_id").alias("formulations"))
    )


@register(
    "dataset_identity",
    oracle(
        "catalogue",
        """SELECT 'v-' || max(p_partkey) AS dataset_version, md5(CAST(sum(p_size) AS VARCHAR)) AS accepted_baseline_sha256,
                  (SELECT count(DISTINCT source) FROM documents) AS source_documents, true AS catalogue_available, 'c-' || max(p_size) AS catalogue_dataset_version,
                  md5(CAST(sum(p_partkey) AS VARCHAR)) AS catalogue_accepted_baseline_sha256, 'Glossary' AS catalogue_source_name, 'identity_only' AS catalogue_source_role,
                  (SELECT count(*) FROM catalogue) AS ingredient_count, CAST(NULL AS VARCHAR) AS catalogue_error, false AS linkage_available FROM part""",
    ),
)
def _(spark, d):
    sources = table(spark, d, "documents").select("source").distinct()
    own = table(spark, d, "part").agg(
        F.concat(F.lit("c-"), F.max("p_size").cast("string")).alias("dataset_version"), F.md5(F.sum("p_partkey").cast("string")).alias("accepted_baseline_sha256")
    ).select("*", F.lit("Glossary").alias("source_name"), F.lit("identity_only").alias("source_role"))
    return formulation.dataset_identity(versions(spark, d), sources, entity(spark, d, "catalogue"), None, own)


def versions(spark, d):
    return table(spark, d, "part").agg(
        F.concat(F.lit("v-"), F.max("p_partkey").cast("string")).alias("dataset_version"),
        F.md5(F.sum("p_size").cast("string")).alias("accepted_baseline_sha256"),
    )


@register(
    "dataset_sources",
    """SELECT (SELECT 'v-' || max(p_partkey) FROM part) AS dataset_version, page_id AS source_document, regexp_extract(url, '^https?://([^/]+)/', 1) AS authority, url AS source_url, sha256(html) AS sha256 FROM pages""",
)
def _(spark, d):
    manifest = table(spark, d, "pages").select(
        F.col("page_id").alias("source_document"), F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("authority"), F.col("url").alias("source_url"), F.sha2("html", 256).alias("sha256")
    )
    return formulation.dataset_sources(versions(spark, d), manifest)


def _label_sql(expr: str) -> str:
    whens = " ".join(f"WHEN '{code}' THEN '{text.replace(chr(39), chr(39) * 2)}'" for code, text in labels.REVIEW_REASON_LABELS.items())
    bare = f"(CASE WHEN strpos({expr}, ': ') > 0 THEN substr({expr}, strpos({expr}, ': ') + 2) ELSE {expr} END)"
    fields = f"regexp_extract({bare}, '^incompatible ([^;]*)', 1)"
    return f"""(CASE WHEN starts_with({bare}, 'incompatible ') THEN
        CASE WHEN {fields} = 'preparation_stage' THEN 'The percentage is for a different preparation stage. Check when this concentration applies.'
             ELSE 'The submitted ' || replace(replace({fields}, 'basis', 'concentration basis'), 'preparation_stage', 'preparation stage') || ' does not match the rule. Check it before comparing the concentration.' END
        ELSE CASE {bare} {whens} ELSE upper(substr(replace({bare}, '_', ' '), 1, 1)) || substr(replace({bare}, '_', ' '), 2) END END)"""


@register(
    "label_codes",
    oracle(
        "o_results",
        f"""r AS (SELECT unnest(review_reasons) AS reason FROM o_results), c AS (SELECT reason, count(*) AS uses FROM r GROUP BY 1)
            SELECT reason, uses, {_label_sql('reason')} AS label FROM c""",
    ),
)
def _(spark, d):
    reasons = results(spark, d).select(F.explode("review_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("uses"))
    return labels.label_codes(reasons, "reason", "reason")


@register(
    "attention_list",
    oracle(
        "o_results",
        f"""a AS (SELECT *, coalesce(review_reasons[1], evaluation_reasons[1], identity_reasons[1]) AS reason FROM o_results
               WHERE review_required OR primary_finding IN ('prohibited_substance_identified', 'restriction_exceeded', 'professional_review_required', 'information_missing', 'identity_unresolved')),
            b AS (SELECT *, CASE WHEN reason IS NOT NULL THEN {_label_sql('reason')} END AS told FROM a),
            c AS (SELECT *, CASE WHEN review_required AND told IS NOT NULL THEN ' · Review: ' || told ELSE '' END AS suffix FROM b)
            SELECT formulation_id, row_number, primary_finding, review_required,
              CASE primary_finding
                WHEN 'prohibited_substance_identified' THEN 'Prohibited-list substance identified · ' || prohibited_rule.s || ' · ' || prohibited_rule.r || suffix
                WHEN 'restriction_exceeded' THEN 'Submitted ' || {_NUM.format('value')} || CASE WHEN unit = 'percent' THEN '%' ELSE ' ' || unit END || ' · Singapore maximum '
                   || {_NUM.format('exceeded_rule.v')} || CASE WHEN exceeded_rule.u = 'percent' THEN '%' ELSE ' ' || exceeded_rule.u END || suffix
                WHEN 'identity_unresolved' THEN 'Identity unresolved' || coalesce(' · ' || told, ' · Human review required')
                WHEN 'information_missing' THEN 'Information missing' || coalesce(' · ' || told, '')
                WHEN 'professional_review_required' THEN 'Human review needed' || coalesce(' · ' || told, '')
                WHEN 'restriction_within_limit' THEN 'Within limit' || coalesce(' · ' || told, ' · Human review required')
                ELSE 'No issue identified within scoped rules' || coalesce(' · ' || told, ' · Human review required') END AS description
            FROM c""",
    ),
)
def _(spark, d):
    return formulation.attention_list(results(spark, d))
