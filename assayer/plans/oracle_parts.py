"""DuckDB-only expressions shared by the oracles: an independent statement of the same semantics."""

from assayer.plans.adapters import ENTITIES


def fold(expr: str) -> str:
    """Regulatory key of ASCII text."""
    return f"coalesce(trim(lower(regexp_replace({expr}, '\\s+', ' ', 'g'))), '')"


def cas_ok(expr: str) -> str:
    body = f"reverse(split_part({expr}, '-', 1) || split_part({expr}, '-', 2))"
    return (
        f"(regexp_full_match({expr}, '[0-9]+-[0-9]+-[0-9]+') AND "
        f"list_sum(list_transform(range(1, length({body}) + 1), lambda i: TRY_CAST(substr({body}, i, 1) AS BIGINT) * i)) % 10"
        f" = TRY_CAST(split_part({expr}, '-', 3) AS BIGINT))"
    )


_LIMIT_JSON = (
    "CASE WHEN limit_value IS NULL THEN '' ELSE '{\"basis\": ' || CASE WHEN limit_basis IS NULL THEN 'null' ELSE '\"' || limit_basis || '\"' END"
    " || ', \"comparator\": \"' || limit_comparator || '\", \"preparation_stage\": \"' || limit_stage || '\", \"unit\": \"' || limit_unit"
    " || '\", \"value\": ' || CAST(limit_value AS VARCHAR) || '}' END"
)

ORACLE_PARTS = {
    "o_sides": (
        ("rules",),
        f"""
        SELECT CASE WHEN regulatory_section IN ('Annex II Part 1', 'Third Schedule Part I')
                    THEN 'annex-ii-to-third-schedule-part-i' ELSE 'annex-iii-to-third-schedule-part-ii' END AS mapping,
               side = 'adv' AS adv, lower(reference_number) AS ref, coalesce(case_label, 'parent') AS label,
               r.*, {_LIMIT_JSON} AS limit_json
        FROM rules r
        """,
    ),
    "o_values": (
        ("o_sides",),
        """
        SELECT mapping, adv, ref, label, rule_id, field, value
        FROM (SELECT mapping, adv, ref, label, rule_id, 'substance_name' AS field, substance_name AS value FROM o_sides
              UNION ALL SELECT mapping, adv, ref, label, rule_id, 'product_context', coalesce(product_context, '') FROM o_sides WHERE restriction_type = 'restricted'
              UNION ALL SELECT mapping, adv, ref, label, rule_id, 'concentration', limit_json FROM o_sides WHERE restriction_type = 'restricted'
              UNION ALL SELECT mapping, adv, ref, label, rule_id, 'other_conditions', coalesce(other_conditions, '') FROM o_sides WHERE restriction_type = 'restricted'
              UNION ALL SELECT mapping, adv, ref, label, rule_id, 'required_warning', coalesce(required_warning, '') FROM o_sides WHERE restriction_type = 'restricted') v
        """,
    ),
    "o_texts": (
        ("o_values",),
        """
        SELECT mapping, adv, ref, field,
               string_agg('[' || label || '] ' || value, chr(10) || '---' || chr(10) ORDER BY CASE WHEN label = 'parent' THEN '' ELSE label END, rule_id) AS text
        FROM o_values GROUP BY ALL
        """,
    ),
    "o_groups": (
        ("o_sides",),
        """
        SELECT mapping, adv, ref, count(*) AS n, min(reference_number) AS reference_number,
               string_agg(label, ',' ORDER BY label) AS labels, min(rule_id) AS first_rule
        FROM o_sides GROUP BY ALL
        """,
    ),
    "o_pairs": (
        ("o_groups", "o_texts"),
        f"""
        SELECT coalesce(a.mapping, c.mapping) AS mapping, coalesce(a.ref, c.ref) AS ref,
               coalesce(a.reference_number, c.reference_number) AS reference_number,
               coalesce(a.n, 0) AS n_acd, coalesce(c.n, 0) AS n_sg, a.labels AS la, c.labels AS lc,
               (SELECT string_agg(x.field, ',' ORDER BY CASE x.field WHEN 'substance_name' THEN 1 WHEN 'product_context' THEN 2
                                  WHEN 'concentration' THEN 3 WHEN 'other_conditions' THEN 4 ELSE 5 END)
                FROM o_texts x JOIN o_texts y ON x.mapping = y.mapping AND x.ref = y.ref AND x.field = y.field AND x.adv AND NOT y.adv
                WHERE x.mapping = coalesce(a.mapping, c.mapping) AND x.ref = coalesce(a.ref, c.ref)
                  AND {fold('x.text')} <> {fold('y.text')}) AS changed
        FROM (SELECT * FROM o_groups WHERE adv) a
        FULL OUTER JOIN (SELECT * FROM o_groups WHERE NOT adv) c ON a.mapping = c.mapping AND a.ref = c.ref
        """,
    ),
    "o_status": (
        ("o_pairs",),
        """
        SELECT *, 'xref-' || mapping || '-' || replace(ref, ' ', '-') AS xref_id,
               CASE WHEN regexp_full_match(reference_number, '(?i)A?[0-9]+[a-z]?\\s*(?:-|to)\\s*A?[0-9]+[a-z]?') THEN 'ambiguous'
                    WHEN n_acd > 0 AND n_sg > 0 AND la <> lc THEN 'ambiguous'
                    WHEN n_acd > 0 AND n_sg > 0 AND changed IS NOT NULL THEN 'changed'
                    WHEN n_acd > 0 AND n_sg > 0 THEN 'aligned'
                    WHEN n_acd > 0 THEN 'acd_only' ELSE 'singapore_only' END AS status
        FROM o_pairs
        """,
    ),
    "o_candidates": (
        ("o_status",),
        f"""
        SELECT s.mapping, s.ref, n.nk, count(DISTINCT o.ref) AS candidates, min(o.ref) AS first_ref
        FROM (SELECT * FROM o_status WHERE status IN ('acd_only', 'singapore_only')) s
        JOIN (SELECT DISTINCT mapping, ref, {fold('substance_name')} AS nk FROM o_sides) n ON n.mapping = s.mapping AND n.ref = s.ref
        JOIN (SELECT DISTINCT mapping, ref, adv, {fold('substance_name')} AS nk FROM o_sides WHERE active) o
          ON o.mapping = s.mapping AND o.nk = n.nk AND o.adv = (s.status = 'singapore_only')
        GROUP BY ALL
        """,
    ),
    "o_bridge": (
        ("o_status",),
        """
        SELECT DISTINCT a.substance_id AS adv_id, c.substance_id AS ctl_id, s.status
        FROM o_sides a JOIN o_sides c ON a.mapping = c.mapping AND a.ref = c.ref AND a.adv AND NOT c.adv
        JOIN o_status s ON s.mapping = a.mapping AND s.ref = a.ref
        """,
    ),
    "o_lookup": (
        ("substances",),
        f"""
        SELECT 'name' AS key_type, {fold('original_substance_name')} AS key, 'exact_name' AS method, substance_id, side = 'adv' AS advisory
        FROM substances WHERE active
        UNION ALL
        SELECT 'name', {fold("substr(original_substance_name, 1, strpos(lower(original_substance_name), ' (except ') - 1)")},
               'derived_source_name_except_clause', substance_id, side = 'adv'
        FROM substances WHERE active AND strpos(lower(original_substance_name), ' (except ') > 1
        UNION ALL
        SELECT 'cas', cas_list, 'exact_cas', substance_id, side = 'adv' FROM substances WHERE active AND {cas_ok('cas_list')}
        """,
    ),
    "o_requests": (
        ("ingredients",),
        f"""
        SELECT DISTINCT name, cas_number, {fold('name')} AS nk, coalesce(trim(cas_number), '') AS ck,
               coalesce({cas_ok('trim(cas_number)')}, false) AS cas_valid
        FROM ingredients
        """,
    ),
    "o_matches": (
        ("o_lookup", "o_requests"),
        """
        SELECT * FROM o_lookup
        WHERE (key_type = 'name' AND key IN (SELECT nk FROM o_requests WHERE nk <> ''))
           OR (key_type = 'cas' AND key IN (SELECT ck FROM o_requests WHERE cas_valid))
        """,
    ),
    "o_reach": (
        ("o_matches", "o_bridge"),
        """
        SELECT key_type, key, substance_id, method, CAST(NULL AS VARCHAR) AS status, true AS direct FROM o_matches WHERE NOT advisory
        UNION ALL
        SELECT key_type, key, ctl_id, method || '_via_acd', status, false FROM o_matches JOIN o_bridge ON adv_id = substance_id WHERE advisory
        """,
    ),
    "o_keys": (
        ("o_reach",),
        """
        SELECT key_type, key, list_sort(list(DISTINCT substance_id)) AS ids,
               list_sort(list(DISTINCT method)) AS methods,
               list_sort(coalesce(list(DISTINCT status) FILTER (WHERE status IS NOT NULL), [])) AS statuses,
               bool_or(direct) AS direct
        FROM o_reach GROUP BY ALL
        """,
    ),
    "o_advisory": (("o_matches",), "SELECT DISTINCT key_type, key FROM o_matches WHERE advisory"),
    "o_sets": (
        ("o_keys", "o_advisory"),
        """
        SELECT r.*, coalesce(n.ids, []) AS nids, coalesce(c.ids, []) AS cids,
               list_sort(list_intersect(coalesce(n.ids, []), coalesce(c.ids, []))) AS common,
               an.key IS NOT NULL AS n_adv, ac.key IS NOT NULL AS c_adv,
               CASE WHEN r.nk <> '' THEN coalesce(n.ids, []) ELSE coalesce(c.ids, []) END AS one_ids,
               CASE WHEN r.nk <> '' THEN n.direct ELSE c.direct END AS one_direct,
               CASE WHEN r.nk <> '' THEN n.statuses ELSE c.statuses END AS one_statuses,
               CASE WHEN r.nk <> '' THEN n.methods ELSE c.methods END AS one_methods,
               CASE WHEN r.nk <> '' THEN an.key IS NOT NULL ELSE ac.key IS NOT NULL END AS one_adv,
               list_sort(list_distinct(list_concat(coalesce(n.methods, []), coalesce(c.methods, [])))) AS all_methods
        FROM o_requests r
        LEFT JOIN o_keys n ON n.key_type = 'name' AND n.key = r.nk AND r.nk <> ''
        LEFT JOIN o_keys c ON c.key_type = 'cas' AND c.key = r.ck AND r.cas_valid
        LEFT JOIN o_advisory an ON an.key_type = 'name' AND an.key = r.nk AND r.nk <> ''
        LEFT JOIN o_advisory ac ON ac.key_type = 'cas' AND ac.key = r.ck AND r.cas_valid
        """,
    ),
    "o_branch": (
        ("o_sets",),
        """
        SELECT *, CASE
          WHEN nk <> '' AND ck <> '' THEN CASE
            WHEN len(nids) = 0 AND len(cids) = 0 AND NOT n_adv AND NOT c_adv THEN 'neither_name_nor_cas_resolved_to_a_source_backed_identity'
            WHEN len(common) = 1 THEN 'agreed'
            WHEN len(nids) > 0 AND len(cids) > 0 AND len(common) = 0 THEN 'supplied_name_and_cas_resolve_to_different_singapore_identities'
            WHEN len(common) > 1 THEN 'supplied_name_and_cas_have_multiple_common_singapore_identities'
            WHEN len(nids) > 0 OR len(cids) > 0 THEN 'only_one_supplied_identifier_provides_a_unique_corroborated_identity'
            ELSE 'supplied_identifiers_do_not_establish_a_unique_singapore_identity' END
          WHEN len(one_ids) = 1 AND (one_direct OR len(one_statuses) = 0 OR one_statuses = ['aligned']) THEN 'single'
          WHEN len(one_ids) = 1 THEN 'singapore_identity_bridge_is_not_aligned'
          WHEN len(one_ids) > 1 THEN 'identifier_matches_multiple_singapore_identities'
          WHEN one_adv THEN 'exact_identity_exists_only_in_the_acd_snapshot'
          ELSE 'no_source_backed_identity_match' END AS branch
        FROM o_sets
        """,
    ),
    "o_resolved": (
        ("o_branch",),
        """
        SELECT b.*,
          CASE WHEN branch IN ('agreed', 'single') THEN 'resolved'
               WHEN branch IN ('neither_name_nor_cas_resolved_to_a_source_backed_identity', 'no_source_backed_identity_match') THEN 'unresolved'
               WHEN branch LIKE '%different_singapore%' OR branch LIKE '%multiple%' THEN 'ambiguous'
               ELSE 'review_required' END AS status,
          CASE branch WHEN 'agreed' THEN common[1] WHEN 'single' THEN one_ids[1] END AS substance_id,
          CASE branch WHEN 'agreed' THEN all_methods WHEN 'single' THEN one_methods ELSE [] END AS match_methods,
          CASE WHEN branch = 'agreed' THEN CASE WHEN EXISTS (SELECT 1 FROM o_reach x WHERE x.direct AND x.substance_id = b.common[1]
                        AND ((x.key_type = 'name' AND x.key = b.nk) OR (x.key_type = 'cas' AND x.key = b.ck)))
                        THEN 'singapore_regulatory_source' ELSE 'acd_regulatory_source' END
               WHEN branch = 'single' THEN CASE WHEN one_direct THEN 'singapore_regulatory_source' ELSE 'acd_regulatory_source' END
               WHEN NOT (nk <> '' AND ck <> '') AND one_adv THEN 'acd_regulatory_source' END AS source_type,
          CASE WHEN branch IN ('agreed', 'single') THEN []
               WHEN ck <> '' AND NOT cas_valid THEN ['supplied_cas_is_malformed', branch]
               ELSE [branch] END AS reasons
        FROM o_branch b
        """,
    ),
    "o_identity": (
        ("o_resolved", "catalogue"),
        """
        SELECT r.name, r.cas_number, r.nk, r.ck,
               CASE WHEN hit THEN CASE WHEN r.ck <> '' THEN 'review_required' ELSE 'resolved' END ELSE r.status END AS status,
               r.substance_id,
               CASE WHEN hit THEN ['exact_catalogue_name'] ELSE r.match_methods END AS match_methods,
               CASE WHEN hit THEN 'ingredient_identity_catalogue' ELSE r.source_type END AS source_type,
               CASE WHEN hit AND r.ck <> '' THEN ['supplied_cas_cannot_be_corroborated_by_catalogue_source']
                    WHEN hit THEN [] ELSE r.reasons END AS reasons,
               CASE WHEN hit THEN c_id END AS catalogue_ingredient_id, CASE WHEN hit THEN c_name END AS catalogue_name
        FROM (SELECT r.*, c.ingredient_id AS c_id, c.canonical_name AS c_name,
                     r.status = 'unresolved' AND r.nk <> '' AND c.ingredient_id IS NOT NULL AS hit
              FROM o_resolved r LEFT JOIN catalogue c ON c.search_name = r.nk) r
        """,
    ),
    "o_contexts": (
        ("rules",),
        f"""
        SELECT {fold('product_context')} AS context_key, min_by(product_context, rule_id) AS product_context
        FROM rules WHERE side = 'ctl' AND coalesce(product_context, '') <> '' GROUP BY 1
        """,
    ),
    "o_rows": (
        ("o_identity",),
        f"""
        SELECT i.*, d.status, d.substance_id, d.match_methods, d.source_type, d.reasons AS identity_reasons,
               d.catalogue_ingredient_id, d.catalogue_name,
               CASE WHEN {fold('i.product_context')} <> '' THEN {fold('i.product_context')} END AS ctx
        FROM ingredients i JOIN o_identity d ON d.name IS NOT DISTINCT FROM i.name AND d.cas_number IS NOT DISTINCT FROM i.cas_number
        """,
    ),
    "o_applicable": (
        ("o_rows", "o_contexts"),
        f"""
        SELECT i.formulation_id, i.row_number, i.value, i.ctx, r.*,
               CASE WHEN coalesce(r.product_context, '') <> '' THEN {fold('r.product_context')} END AS rctx,
               array_to_string(list_filter([CASE WHEN i.unit IS NOT NULL AND lower(i.unit) IS DISTINCT FROM lower(r.limit_unit) THEN 'unit' END,
                     CASE WHEN lower(i.basis) IS DISTINCT FROM lower(r.limit_basis) THEN 'basis' END,
                     CASE WHEN lower(i.preparation_stage) IS DISTINCT FROM lower(r.limit_stage) THEN 'preparation_stage' END],
                     lambda x: x IS NOT NULL), ', ') AS mismatch
        FROM o_rows i JOIN rules r ON r.substance_id = i.substance_id AND r.side = 'ctl'
        WHERE i.status = 'resolved'
        """,
    ),
    "o_decided": (
        ("o_applicable",),
        """
        SELECT a.*, CASE
          WHEN NOT active OR normalization_status = 'inactive_source_entry' THEN
            CASE WHEN unresolved_current_applicability THEN 'inactive_open' ELSE 'inactive' END
          WHEN regulatory_section = 'Third Schedule Part I' THEN
            CASE WHEN normalization_status = 'normalized' THEN 'prohibited' ELSE 'prohibition_review' END
          WHEN rctx IS NOT NULL AND rctx <> 'all products' AND ctx IS NULL THEN 'context_missing'
          WHEN normalization_status <> 'normalized' THEN 'restriction_review'
          WHEN rctx IS NOT NULL AND rctx <> 'all products' AND ctx NOT IN (SELECT context_key FROM o_contexts) THEN 'context_unknown'
          WHEN rctx IS NOT NULL AND rctx <> 'all products' AND ctx <> rctx THEN 'other_context'
          WHEN limit_value IS NULL THEN 'no_limit'
          WHEN limit_stage IN ('', 'unspecified') THEN 'stage_open'
          WHEN value IS NULL THEN 'amount_missing'
          WHEN mismatch <> '' THEN 'incompatible'
          WHEN limit_comparator NOT IN ('less_than_or_equal', 'less_than') THEN 'unsupported'
          WHEN CASE WHEN limit_comparator = 'less_than' THEN value < limit_value ELSE value <= limit_value END THEN 'within'
          ELSE 'exceeded' END AS branch
        FROM o_applicable a
        """,
    ),
    "o_evaluations": (
        ("o_decided",),
        """
        SELECT d.*,
          CASE branch WHEN 'inactive_open' THEN [rule_id || ': inactive record has unresolved current applicability']
            WHEN 'context_missing' THEN [rule_id || ': product context is required']
            WHEN 'context_unknown' THEN [rule_id || ': submitted product context is not an exact source-backed context']
            WHEN 'no_limit' THEN [rule_id || ': normalized restriction has no executable concentration constraint']
            WHEN 'stage_open' THEN [rule_id || ': source preparation stage is not sufficiently specified for comparison']
            WHEN 'amount_missing' THEN [rule_id || ': concentration value, unit, basis, and stage are required']
            WHEN 'incompatible' THEN [rule_id || ': incompatible ' || mismatch || '; no conversion performed']
            WHEN 'unsupported' THEN [rule_id || ': unsupported comparator or numerical limit']
            WHEN 'prohibition_review' THEN CASE WHEN reason_list = '' THEN ['prohibition semantics require professional review'] ELSE string_split(reason_list, ',') END
            WHEN 'restriction_review' THEN CASE WHEN reason_list = '' THEN ['restriction semantics require professional review'] ELSE string_split(reason_list, ',') END
            WHEN 'within' THEN extra WHEN 'exceeded' THEN extra ELSE [] END AS reasons
        FROM (SELECT *, list_filter([CASE WHEN trim(coalesce(other_conditions, '')) <> '' THEN 'other regulatory requirements were returned as evidence but not evaluated' END,
                           CASE WHEN trim(coalesce(required_warning, '')) <> '' THEN 'required warning was returned as evidence but not evaluated' END], lambda x: x IS NOT NULL) AS extra
              FROM o_decided) d
        """,
    ),
    "o_aggregated": (
        ("o_evaluations",),
        """
        SELECT formulation_id, row_number,
               bool_or(branch = 'prohibited') AS prohibited, bool_or(branch = 'exceeded') AS exceeded, bool_or(branch = 'within') AS within_limit,
               bool_or(branch IN ('context_missing', 'amount_missing')) AS missing,
               flatten(list(CASE WHEN branch IN ('prohibition_review', 'restriction_review', 'within', 'exceeded')
                             THEN list_transform(reasons, lambda x: rule_id || ': ' || x) ELSE reasons END ORDER BY rule_id)
                       FILTER (WHERE branch NOT IN ('context_missing', 'amount_missing'))) AS review_reasons,
               flatten(list(reasons ORDER BY rule_id) FILTER (WHERE branch <> 'inactive')) AS evaluation_reasons,
               min_by(struct_pack(s := regulatory_section, r := reference_number, n := substance_name, v := limit_value, u := limit_unit), rule_id)
                 FILTER (WHERE branch = 'prohibited') AS prohibited_rule,
               min_by(struct_pack(s := regulatory_section, r := reference_number, n := substance_name, v := limit_value, u := limit_unit), rule_id)
                 FILTER (WHERE branch = 'exceeded') AS exceeded_rule,
               min_by(struct_pack(s := regulatory_section, r := reference_number, n := substance_name, v := limit_value, u := limit_unit), rule_id)
                 FILTER (WHERE branch = 'within') AS within_rule
        FROM o_evaluations GROUP BY ALL
        """,
    ),
    "o_results": (
        ("o_aggregated",),
        """
        SELECT r.formulation_id, r.row_number, r.name, r.cas_number, r.value, r.unit, r.product_context, r.status, r.substance_id, r.match_methods, r.source_type,
               r.identity_reasons, r.catalogue_ingredient_id, r.catalogue_name,
               CASE WHEN r.status = 'unresolved' THEN 'identity_unresolved'
                    WHEN r.status <> 'resolved' THEN 'professional_review_required'
                    WHEN prohibited THEN 'prohibited_substance_identified'
                    WHEN exceeded THEN 'restriction_exceeded'
                    WHEN len(review_reasons) > 0 THEN 'professional_review_required'
                    WHEN missing THEN 'information_missing'
                    WHEN within_limit THEN 'restriction_within_limit'
                    ELSE 'no_issue_identified_within_scoped_rules' END AS primary_finding,
               CASE WHEN r.status <> 'resolved' THEN r.identity_reasons ELSE list_filter(coalesce(a.review_reasons, []), lambda x, i: list_position(a.review_reasons, x) = i) END AS review_reasons,
               r.status <> 'resolved' OR coalesce(len(a.review_reasons), 0) > 0 AS review_required,
               CASE WHEN r.status <> 'resolved' THEN 'identity_review' WHEN coalesce(len(a.review_reasons), 0) > 0 THEN 'rule_review' END AS review_type,
               coalesce(prohibited, false) AS has_prohibited, coalesce(exceeded, false) AS has_exceeded, coalesce(within_limit, false) AS has_within,
               prohibited_rule, exceeded_rule, within_rule, coalesce(evaluation_reasons, []) AS evaluation_reasons
        FROM o_rows r LEFT JOIN o_aggregated a ON a.formulation_id = r.formulation_id AND a.row_number = r.row_number
        """,
    ),
}

ENTITIES.update(ORACLE_PARTS)
