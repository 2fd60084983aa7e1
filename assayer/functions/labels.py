"""Readable labels for codes. The texts are fixed values; the service name is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVIEW_REASON_LABELS = {
    "no_source_backed_identity_match": "We could not match this ingredient to a trusted source. Check the name or CAS number.",
    "neither_name_nor_cas_resolved_to_a_source_backed_identity": "We could not match the name or CAS number. Check both values.",
    "supplied_name_and_cas_resolve_to_different_singapore_identities": "The ingredient name and CAS number point to different substances. Check which one is correct.",
    "supplied_name_and_cas_have_multiple_common_singapore_identities": "The name and CAS number still leave more than one possible ingredient. Confirm the correct one.",
    "only_one_supplied_identifier_provides_a_unique_corroborated_identity": "Only the name or CAS number matched. Check the other value.",
    "supplied_identifiers_do_not_establish_a_unique_singapore_identity": "The submitted details do not identify one clear ingredient. Check the name and CAS number.",
    "singapore_identity_bridge_is_not_aligned": "The ACD and Singapore records do not clearly point to the same ingredient. Compare both sources.",
    "identifier_matches_multiple_singapore_identities": "This identifier matches more than one Singapore ingredient. Confirm the correct one.",
    "exact_identity_exists_only_in_the_acd_snapshot": "This ingredient appears in the ACD source, but its Singapore match is unclear. Compare the sources.",
    "supplied_cas_is_malformed": "The CAS number is not in a valid format. Check it.",
    "source_wording_or_regulatory_field_differs": "The ACD and Singapore records differ. Compare the source wording before deciding.",
    "ambiguous_multi_case_concentration_not_normalized": "This rule has several limits. Confirm which one applies to this product.",
    "conditional_prohibition_wording_not_structured": "This rule has an exception that still needs checking.",
    "additional_numeric_condition_not_structured": "This rule has another number or limit that the system cannot check automatically.",
    "concentration_condition_not_normalized": "The system could not apply this concentration limit automatically. Check the source rule.",
    "concentration_contains_multiple_or_ambiguous_values": "The rule lists more than one possible concentration. Confirm which value applies.",
    "multi_case_mapping_not_unambiguous": "The rule has several cases, and the system cannot tell which one applies.",
    "no_current_singapore_reference_number_match": "The ACD record has no clear matching Singapore reference. Check the current Singapore source.",
    "non_exhaustive_identifier_scope_not_structured": "The source describes a group of substances. Check whether this ingredient is included.",
    "normalized_case_structure_differs_between_sources": "The ACD and Singapore versions organise the cases differently. Compare them.",
    "ranged_reference_prevents_unique_entry_correspondence": "The source uses a range of references, so the exact matching entry is unclear.",
    "jurisdiction_specific_source_wording": "The ACD and Singapore wording differs. Check which Singapore wording applies.",
    "malformed_cas_identifier_preserved": "The source contains an unusual CAS number. Check it against the original document.",
    "blank_deleted_or_ranged_source_entry": "The source entry is blank, deleted, or covers a range and needs checking.",
    "catalogue_identity_singapore_linkage_unresolved": "The ingredient name is recognised, but its Singapore identity still needs checking.",
    "ingredient_catalogue_unavailable_identity_verification_withheld": "The ingredient-name catalogue is unavailable. Check the identity manually.",
    "ingredient_linkage_baseline_unavailable": "The older identity-linkage file is unavailable. Check the identity manually.",
    "linkage_not_valid_for_active_baseline": "The saved identity link does not match the current source versions. Check it again.",
    "supplied_cas_cannot_be_corroborated_by_catalogue_source": "The ingredient catalogue contains names only, so it cannot confirm the submitted CAS number.",
    # reasons produced while a rule is evaluated
    "normalized restriction has no executable concentration constraint": "The rule does not contain a limit the system can compare automatically. Check the source rule.",
    "source preparation stage is not sufficiently specified for comparison": "The rule does not clearly say when its concentration limit applies. Check the source wording.",
    "concentration value, unit, basis, and stage are required": "Add the concentration details before this rule can be checked.",
    "unsupported comparator or numerical limit": "The rule's limit cannot be calculated automatically. Check the source value.",
    "other regulatory requirements were returned as evidence but not evaluated": "This rule has other requirements that still need to be checked.",
    "required warning was returned as evidence but not evaluated": "This rule includes a warning that still needs to be checked.",
}
STATUS_LABELS = {
    "changed": "Changed",
    "aligned": "Aligned",
    "acd_only": "ACD only",
    "singapore_only": "Singapore only",
    "ambiguous": "Ambiguous",
    "deterministic": "Deterministic",
    "withheld_professional_review": "Withheld for professional review",
    "withheld_information_missing": "Information missing",
    "not_applicable_to_submitted_context": "Not applicable to submitted context",
    "resolved": "Resolved",
    "unresolved": "Unresolved",
    "review_required": "Review required",
    "not_applicable": "Not applicable",
    "linked": "Linked",
    "verified_not_represented": "Verified not represented in scoped lists",
}
METHOD_LABELS = {
    "exact_name": "Exact source-backed name",
    "exact_cas": "Exact source-backed CAS",
    "exact_name_via_acd": "Exact name via ACD cross-reference",
    "exact_cas_via_acd": "Exact CAS via ACD cross-reference",
    "exact_catalogue_name": "Exact EU catalogue name",
    "accepted_catalogue_linkage": "Accepted EU-to-Singapore identity linkage",
    "accepted_verified_not_represented": "Accepted scoped absence review",
}
FIELD_LABELS = {
    "substance_name": "Source substance wording",
    "product_context": "Product context",
    "concentration": "Concentration",
    "other_conditions": "Other requirements",
    "required_warning": "Required warning",
}
REVIEW_TYPE_LABELS = {"identity_review": "Ingredient identity", "rule_review": "How the rule applies"}
STAGE_LABELS = {
    "finished_product": "Finished product",
    "after_mixing": "After mixing for use",
    "ready_for_use": "Ready for use",
}
COMPARATOR_LABELS = {"less_than_or_equal": "At most", "less_than": "Less than"}
INCOMPATIBLE_LABELS = {"unit": "unit", "basis": "concentration basis", "preparation_stage": "preparation stage"}
FINDING_LABELS = {
    "prohibited_substance_identified": "Prohibited-list substance identified",
    "restriction_exceeded": "Limit exceeded",
    "restriction_within_limit": "Within limit",
    "professional_review_required": "Needs human review",
    "information_missing": "Information missing",
    "identity_unresolved": "Identity unresolved",
    "no_issue_identified_within_scoped_rules": "No issue identified within scoped rules",
}


def _lookup(labels: dict[str, str], code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), code)


def _spaced(code: Column) -> Column:
    words = F.replace(code, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substr(words, F.lit(1), F.lit(1))), F.substr(words, F.lit(2)))


def code(value: Column) -> Column:
    return F.coalesce(_lookup(STATUS_LABELS, value), _spaced(value))


def method(value: Column) -> Column:
    return F.coalesce(_lookup(METHOD_LABELS, value), code(value))


def field_name(value: Column) -> Column:
    return F.coalesce(_lookup(FIELD_LABELS, value), code(value))


def review_type(value: Column) -> Column:
    return F.coalesce(_lookup(REVIEW_TYPE_LABELS, value), code(value))


def finding(value: Column) -> Column:
    return _lookup(FINDING_LABELS, value)


def preparation_stage(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "—").otherwise(
        F.coalesce(_lookup(STAGE_LABELS, value), code(value))
    )


def comparator(value: Column) -> Column:
    return F.coalesce(_lookup(COMPARATOR_LABELS, value), code(F.coalesce(value, F.lit("Unspecified"))))


def number(value: Column) -> Column:
    """A number written out in full, without a trailing ``.0``: its shortest digits, never an exponent."""
    shortest = value.cast("string")
    written = value.cast("decimal(38,18)").cast("string")
    full = F.regexp_replace(F.regexp_replace(written, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(shortest.contains("E"), full).otherwise(F.regexp_replace(shortest, r"\.0$", ""))


def amount(value: Column, unit: Column) -> Column:
    suffix = F.when(unit == "percent", "%").otherwise(F.concat(F.lit(" "), F.coalesce(unit, F.lit(""))))
    return F.concat(number(value), suffix)


def rule_concentration(limit: Column, with_source_text: bool = True) -> Column:
    text = limit["source_text"] if with_source_text else F.lit(None).cast("string")
    return F.when(limit["value"].isNull(), F.coalesce(text, F.lit("—"))).otherwise(amount(limit["value"], limit["unit"]))


def review_reason(value: Column) -> Column:
    """Readable text of a reason; a leading ``rule: `` is dropped and ``incompatible`` is spelled out."""
    at = F.instr(value, ": ")
    reason = F.when(at > 0, F.substr(value, at + 2)).otherwise(value)
    fields = F.split(F.regexp_extract(reason, "^incompatible ([^;]*)", 1), ", ")
    readable = F.transform(
        fields, lambda f: F.coalesce(_lookup(INCOMPATIBLE_LABELS, f), F.lower(code(f)))
    )
    only_stage = (F.size(fields) == 1) & (F.get(fields, F.lit(0)) == "preparation_stage")
    incompatible = F.when(
        only_stage, "The percentage is for a different preparation stage. Check when this concentration applies."
    ).otherwise(
        F.concat(
            F.lit("The submitted "),
            F.array_join(readable, ", "),
            F.lit(" does not match the rule. Check it before comparing the concentration."),
        )
    )
    return F.when(reason.startswith("incompatible "), incompatible).otherwise(
        F.coalesce(_lookup(REVIEW_REASON_LABELS, reason), code(reason))
    )


_KINDS = {
    "reason": review_reason,
    "status": code,
    "method": method,
    "field": field_name,
    "review_type": review_type,
    "finding": finding,
    "stage": preparation_stage,
    "comparator": comparator,
}


def label_codes(df: DataFrame, column: str, kind: str, out: str = "label") -> DataFrame:
    return df.withColumn(out, _KINDS[kind](F.col(column)))
