"""Fixed values that results depend on.

Everything in the "fixed values" blocks below must stay exactly as written:
the cleaning rules, word lists and patterns of the ticket reports are defined
by them. Operators take them as default parameters, so callers can override.
"""

from __future__ import annotations


# ---------------------------------------------------------------------------
# Ticket source columns and the names used in this library.
# ---------------------------------------------------------------------------
SOURCE_COLUMNS = {
    "Id": "id",
    "CaseNumber": "case_number",
    "Account.Account_Name__c": "account_name",
    "Group_Id__c": "group_id",
    "Subject": "subject",
    "Description": "description",
    "Product_Area__c": "product_area",
    "Product_Feature__c": "product_feature",
    "POD_Name__c": "pod_name",
    "CreatedDate": "created_at",
    "ClosedDate": "closed_at",
    "First_Response_Time__c": "first_response_at",
    "Case_Type__c": "case_type",
    "Case_Owner__c": "case_owner",
    "Age_days__c": "age_days",
    "IsEscalated": "is_escalated",
    "CSAT__c": "csat",
    "Internal_Priority__c": "priority",
    "RCA__c": "rca",
    "Status": "status",
}
# Columns every ticket file is expected to have (the rest are optional).
REQUIRED_COLUMNS = (
    "id", "case_number", "account_name", "group_id", "subject", "description",
    "product_area", "product_feature", "pod_name", "created_at", "closed_at",
    "case_type", "age_days", "is_escalated", "csat", "priority",
)

# ---------------------------------------------------------------------------
# Cleaning rules.
# ---------------------------------------------------------------------------
# Text columns that are turned into strings and whose missing values get a label.
LABELLED_COLUMNS = (
    "product_area", "product_feature", "pod_name", "group_id", "account_name",
    "priority", "case_owner", "case_type", "rca",
)
# Label given to a missing value of a labelled column. The original program
# turns missing values into the text "nan" before it fills them, so "nan" is the
# faithful default; "Unspecified" is what it meant to do.
MISSING_LABEL = "nan"
UNSPECIFIED = "Unspecified"
MERGED_STATUS = "Merged"
# Queue owners whose tickets are left out (compared case-insensitively).
EXCLUDED_OWNERS = (
    "Spam", "Support", "Infosec queue", "Deal Desk", "Sales Ops", "AI Help",
    "ISR Queue", "PD Queue", "RFx Intake",
)
# Case types that put an owner in the support/service engineer group.
SUPPORT_CASE_TYPES = ("support request", "service request")
OWNER_GROUP_SUPPORT = "TSE and PSE"
OWNER_GROUP_OTHER = "Non TSE and PSE"
# Date formats tried after ISO-8601 (month first), as Spark datetime patterns.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy HH:mm:ss", "M/d/yyyy")
PRIORITY_PATTERN = "^P[0-9]+$"
PRIORITY_RANK_DEFAULT = 999
# Tokens a CSV reader treats as missing (the pandas defaults).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# ---------------------------------------------------------------------------
# Report thresholds.
# ---------------------------------------------------------------------------
TOP_ACCOUNTS = 10
ACTIVE_ACCOUNT_MIN_TICKETS = 5
ACCOUNT_LABEL_LENGTH = 15
TOP_CAUSES = 5
TOP_WORDS = 100
SUBJECT_START_LENGTH = 20
TOP_SUBJECT_STARTS = 10
SAMPLE_ISSUES = 10
SIMILARITY_THRESHOLD = 0.8

# ---------------------------------------------------------------------------
# Word-frequency stop words added for support tickets.
# ---------------------------------------------------------------------------
TICKET_STOP_WORDS = (
    "nan", "none", "null", "unspecified", "undefined", "unknown",
    "ticket", "case", "issue", "problem", "request", "support",
    "customer", "user", "client", "team", "please", "thanks",
    "hello", "hi", "hey", "dear", "greetings", "regards",
    "morning", "afternoon", "evening",
    "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did",
    "will", "would", "should", "could", "may", "might",
    "must", "can", "cannot", "cant", "wont", "want",
    "need", "needed", "needs", "required", "requiring",
    "facing", "seeing", "looking", "trying", "tried",
    "getting", "got", "received", "receiving",
    "the", "a", "an", "and", "or", "but", "nor", "for",
    "yet", "so", "although", "because", "before", "after",
    "when", "while", "where", "why", "how",
    "0", "1", "2", "3", "4", "5", "6", "7", "8", "9",
    "@", "#", "$", "%", "&", "*", "(", ")", "-", "_",
    "+", "=", "[", "]", "{", "}", "|", "\\", "/", "<", ">",
    "today", "yesterday", "tomorrow", "week", "month", "year",
    "monday", "tuesday", "wednesday", "thursday", "friday",
    "saturday", "sunday", "jan", "feb", "mar", "apr", "may",
    "jun", "jul", "aug", "sep", "oct", "nov", "dec",
)
# A word is a run of letters, digits, underscores and apostrophes that does not
# start with an apostrophe (Unicode classes, so the same in Java and RE2).
WORD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"

# ---------------------------------------------------------------------------
# Data-quality report.
# ---------------------------------------------------------------------------
# Values a completeness profile counts as "empty" (exact, case-sensitive).
EMPTY_TOKENS = ("", "Unspecified", "None", "null", "NA")
# Fields whose completeness is profiled by default.
PROFILE_FIELDS = (
    "account_name", "subject", "description", "product_area", "product_feature",
    "pod_name", "case_type", "priority", "rca",
)
# Generic subject beginnings, matched on the lower-cased subject.
GENERIC_SUBJECT_PATTERNS = (
    r"^help\s+needed",
    r"^issue\s+with",
    r"^problem\s+with",
    r"^error",
    r"^question",
    r"^assistance\s+needed",
    r"^support\s+needed",
)
# Data-platform / analytics selection.
DP_ANALYTICS_PATTERN = "DP|Analytics"
DP_POD_NAME = "CI-Analytics"
DP_POD_PREFIX = "DP"
# Data-quality terms, in the original order (two appear twice).
DATA_QUALITY_TERMS = (
    r"data\s*quality", r"data\s*governance", r"data\s*validation", r"data\s*accuracy",
    r"data\s*integrity", r"data\s*consistency", r"data\s*completeness", r"data\s*reliability",
    r"data\s*cleansing", r"data\s*cleanup", r"data\s*standardization", r"data\s*enrichment",
    r"data\s*profiling", r"data\s*monitoring", r"data\s*lineage", r"data\s*catalog",
    r"data\s*classification", r"data\s*security", r"data\s*privacy", r"data\s*compliance",
    r"data\s*protection", r"data\s*governance", r"data\s*stewardship", r"data\s*management",
    r"data\s*issue", r"data\s*error", r"data\s*corruption", r"data\s*anomaly",
    r"data\s*discrepancy", r"data\s*reconciliation", r"data\s*quality\s*check",
    r"data\s*inconsistency", r"data\s*mismatch", r"data\s*incorrect",
    r"incorrect\s*data", r"mismatched\s*data", r"inconsistent\s*data",
    r"sync\s*issue", r"sync\s*error", r"synchronization", r"data\s*sync",
    r"gdpr", r"data\s*protection\s*regulation", r"data\s*privacy",
    r"wrong\s*data", r"invalid\s*data", r"corrupt\s*data",
)
# Every term above contains one of these words, so a text without any of them
# cannot match a term (used as a cheap exact pre-filter).
DATA_QUALITY_ANCHORS = ("data", "sync", "gdpr")
# Ticket fields searched for data-quality terms, in order.
ISSUE_FIELDS = ("subject", "product_area", "product_feature", "description", "pod_name", "rca")
SAMPLE_COLUMNS = ("id", "subject", "product_area", "product_feature", "pod_name", "created_at")
# Python's `\s` on text: the characters str.isspace() accepts. Java and RE2
# disagree with it and with each other, so patterns spell the class out.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def term_name(pattern: str) -> str:
    """Display name of a term pattern: ``data\\s*quality`` -> ``data quality``."""
    return pattern.replace(r"\s*", " ").strip()


def distinct_terms() -> list[tuple[str, str]]:
    """(name, pattern) per distinct term, first occurrence kept."""
    seen: dict[str, str] = {}
    for p in DATA_QUALITY_TERMS:
        seen.setdefault(term_name(p), p)
    return list(seen.items())


def portable_regex(pattern: str) -> str:
    """Replace ``\\s`` by the explicit Python whitespace class."""
    return pattern.replace(r"\s", PY_WHITESPACE_CLASS)


# ---------------------------------------------------------------------------
# The default English stop words of Spark ML's StopWordsRemover.
# ---------------------------------------------------------------------------
ENGLISH_STOP_WORDS = tuple("""
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
    i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
    they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
    shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
    what's when's where's who's why's would
""".split())


def all_stop_words() -> tuple[str, ...]:
    return tuple(sorted(set(ENGLISH_STOP_WORDS) | set(TICKET_STOP_WORDS)))
