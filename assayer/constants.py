"""Fixed values of the screening domain. They must stay as they are for results to be right."""

# Sections of the two snapshots: controlling (local law) and advisory (regional directive).
PROHIBITED_SECTION = "Third Schedule Part I"
RESTRICTED_SECTION = "Third Schedule Part II"
CONTROLLING_SECTIONS = (PROHIBITED_SECTION, RESTRICTED_SECTION)
ADVISORY_PROHIBITED_SECTION = "Annex II Part 1"
ADVISORY_RESTRICTED_SECTION = "Annex III Part 1"
ADVISORY_SECTIONS = (ADVISORY_PROHIBITED_SECTION, ADVISORY_RESTRICTED_SECTION)
ALL_SECTIONS = (
    "Appendix I",
    "Annex II Part 1",
    "Annex III Part 1",
    "Regulation 6",
    "Third Schedule Part I",
    "Third Schedule Part II",
)
RULE_ID_PREFIXES = {
    "Annex II Part 1": "acd-ii",
    "Annex III Part 1": "acd-iii",
    "Third Schedule Part I": "sg-third-schedule-i",
    "Third Schedule Part II": "sg-third-schedule-ii",
}
# mapping name -> (advisory section, controlling section)
SECTION_MAPPINGS = {
    "annex-ii-to-third-schedule-part-i": ("Annex II Part 1", "Third Schedule Part I"),
    "annex-iii-to-third-schedule-part-ii": ("Annex III Part 1", "Third Schedule Part II"),
}
SECTION_PROVISIONS = {
    "Third Schedule Part I": ("sg-regulation-6-1", "sg-regulation-6-7"),
    "Third Schedule Part II": ("sg-regulation-6-2", "sg-regulation-6-7"),
}

# Findings
NO_ISSUE = "no_issue_identified_within_scoped_rules"
WITHIN_LIMIT = "restriction_within_limit"
EXCEEDED = "restriction_exceeded"
PROHIBITED = "prohibited_substance_identified"
MISSING = "information_missing"
UNRESOLVED = "identity_unresolved"
REVIEW = "professional_review_required"
FINDINGS = (PROHIBITED, EXCEEDED, WITHIN_LIMIT, REVIEW, MISSING, UNRESOLVED, NO_ISSUE)
ADVERSE_FINDINGS = (PROHIBITED, EXCEEDED, REVIEW, MISSING, UNRESOLVED)
DETERMINISTIC_FINDINGS = (PROHIBITED, EXCEEDED, WITHIN_LIMIT)
# Order in which a confirmed finding backs the shown one when no evaluation equals it.
SUPPORT_ORDER = (PROHIBITED, EXCEEDED, WITHIN_LIMIT, MISSING, NO_ISSUE)

CONCENTRATION_UNITS = ("percent", "mg/kg", "ppm")
CONCENTRATION_BASES = ("NH3", "free base", "zinc", "sulphate", "hydrochloride", "tetrahydrochloride")
PREPARATION_STAGES = ("finished_product", "after_mixing", "ready_for_use")
COMPARISON_STATUSES = ("aligned", "changed", "acd_only", "singapore_only", "ambiguous")
LINKAGE_STATUSES = ("linked", "verified_not_represented", "unresolved")

UNIT_SYNONYMS = {"%": "percent", "percent": "percent", "ppm": "ppm", "mg/kg": "mg/kg"}
STAGE_SYNONYMS = {
    "finished_product": "finished_product",
    "after_mixing": "after_mixing",
    "after_mixing_for_use": "after_mixing",
    "ready_for_use": "ready_for_use",
}
UNAVAILABLE_AMOUNTS = ("q.s.", "q.s", "qs", "balance")

CONDITIONAL_PHRASES = (
    "except",
    "exception",
    "unless",
    "when used",
    "if they contain",
    "provided that",
    "provided the",
    "shall be below",
    "does not exceed",
    "trace limit",
)
NON_EXHAUSTIVE_PHRASE = "not limited to the specified cas"
INACTIVE_NAMES = (
    "deleted",
    "entry deleted",
    "entry left intentionally blank",
    "entry intentionally left blank",
    "entries left intentionally blank",
)
INACTIVE_NAME_START = "moved or deleted"
JURISDICTIONS = ("singapore", "indonesia", "malaysia", "thailand", "lao pdr")

# Patterns (Java regular expressions)
REFERENCE_PATTERN = r"(?i)^(?:A?[0-9]+[a-z]?)(?:\s*(?:-|to)\s*(?:A?[0-9]+[a-z]?))?$"
RANGE_PATTERN = r"(?i)^A?[0-9]+[a-z]?\s*(?:-|to)\s*A?[0-9]+[a-z]?$"
IDENTIFIER_PATTERN = r"(?U)(?<![0-9])([0-9]{2,7})\s*-\s*([0-9]{1,3})\s*-\s*([0-9]?)(?![0-9])"
IDENTIFIER_STRUCTURE = r"^[0-9]{2,7}-[0-9]{2}-[0-9]$"
LIMIT_PATTERN = r"(?iU)(?<![0-9.])([0-9]+(?:\.[0-9]+)?)\s*(%|mg\s*/\s*kg|ppm)"
SECONDARY_LIMIT_PATTERN = (
    "(?iU)(?<![0-9.])[0-9]+(?:[.,][0-9]+)?\\s*(?:[μµ]g\\s*/\\s*kg|kda)\\b"
)
CASE_PATTERN = r"(?dmiU)^\s*(?:\(([a-z])\)|([a-z])\))\s*"
BASIS_PATTERN = r"(?iU)\b(?:calculated|expressed)\s+as\s+([^\n.;]+)"
BASIS_BRACKET_PATTERN = r"(?iU)\(\s*as\s+([^)]+)\)"

# Upload limits
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_ROWS = 500
MAX_COLUMNS = 50
MAX_CELL_CHARACTERS = 8192
MAX_DECODED_CHARACTERS = 250000
UPLOAD_SUFFIXES = ("csv", "tsv", "txt", "xlsx", "xls", "json", "pdf")

SESSION_GAP_SECONDS = 3600
MAX_SESSIONS = 100
MAX_ATTEMPTS = 3
MAX_EXPLANATIONS = 50

# Review pack: category -> reason that a rule must carry (two categories use cross-references).
REVIEW_CATEGORIES = (
    "conditional_prohibition",
    "ambiguous_multi_case_restriction",
    "secondary_numerical_condition",
    "active_acd_only",
    "materially_changed_cross_reference",
)
REVIEW_REASONS = {
    "conditional_prohibition": "conditional_prohibition_wording_not_structured",
    "ambiguous_multi_case_restriction": "multi_case_mapping_not_unambiguous",
    "secondary_numerical_condition": "additional_numeric_condition_not_structured",
}
REVIEW_QUESTIONS = {
    "conditional_prohibition": "How should the stated exception be represented and evaluated for Singapore screening?",
    "ambiguous_multi_case_restriction": "Can the source cases be mapped into separate executable rules without adding an interpretation?",
    "secondary_numerical_condition": "How should the additional numerical condition be represented and when is it applicable?",
    "active_acd_only": "Does this newer ACD entry have any current Singapore effect, or should it remain comparison evidence only?",
    "materially_changed_cross_reference": "Does this source difference affect Singapore screening, and which exact condition should the reviewer apply?",
}

# White space as Python's str.strip sees it; a value of nothing else is blank.
WHITESPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
BLANK = rf"\A[{WHITESPACE}]*+\z"

# Phrases that a generated explanation may not contain: fixed values that must match.
BANNED_CLAIMS = r"(?i)\b(?:allow(?:ed)?|permit(?:ted)?|approv(?:ed|al)?|compliant|compliance|legal|safe|unsafe|safety)\b"
BANNED_JARGON = (
    r"(?i)\b(?:conditional wording|cited entry|corroborated identity|identifier evidence|"
    r"structure automatically|professional verification requested|applicable regulatory provision|"
    r"exception conditions associated with the entry)\b"
)
BANNED_JARGON = (
    r"(?i)\b(?:conditional wording|cited entry|corroborated identity|identifier evidence|"
    r"structure automatically|professional verification requested|applicable regulatory provision|"
    r"exception conditions associated with the entry)\b"
)
