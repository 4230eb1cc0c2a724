"""Fixed values, written out once more: the SQL twins take theirs from the same
constants, so a wrong one would show nowhere else."""

import hashlib

from ticketlab import constants as K

ENGLISH, ALL = 181, 285
DIGEST = "b8637cd2f246a83d9712933825db3a02f733b8562f606461fd2b659e7aad0095"     # of the sorted words, one a line
TERMS = """
data quality, data governance, data validation, data accuracy, data integrity, data consistency, data completeness,
data reliability, data cleansing, data cleanup, data standardization, data enrichment, data profiling, data monitoring,
data lineage, data catalog, data classification, data security, data privacy, data compliance, data protection,
data governance, data stewardship, data management, data issue, data error, data corruption, data anomaly,
data discrepancy, data reconciliation, data quality check, data inconsistency, data mismatch, data incorrect,
incorrect data, mismatched data, inconsistent data, sync issue, sync error, synchronization, data sync, gdpr,
data protection regulation, data privacy, wrong data, invalid data, corrupt data
"""


def test_terms():
    terms = [t.strip() for t in TERMS.replace("\n", " ").split(",")]
    assert len(terms) == 47 and [K.term_name(p) for p in K.DATA_QUALITY_TERMS] == terms
    assert len(K.distinct_terms()) == 45
    assert all(p == t.replace(" ", r"\s*") for p, t in zip(K.DATA_QUALITY_TERMS, terms))


def test_owners():
    assert sorted(o.lower() for o in K.EXCLUDED_OWNERS) == [
        "ai help", "deal desk", "infosec queue", "isr queue", "pd queue", "rfx intake", "sales ops", "spam", "support"]


def test_stop_words():
    words = K.all_stop_words()
    assert (len(set(K.ENGLISH_STOP_WORDS)), len(words)) == (ENGLISH, ALL)
    assert hashlib.sha256("\n".join(words).encode()).hexdigest() == DIGEST


def test_labels_and_patterns():
    assert (K.MISSING_LABEL, K.UNSPECIFIED, K.MERGED_STATUS) == ("nan", "Unspecified", "Merged")
    assert (K.DP_ANALYTICS_PATTERN, K.DP_POD_NAME, K.DP_POD_PREFIX, K.PRIORITY_PATTERN) == ("DP|Analytics", "CI-Analytics", "DP", "^P[0-9]+$")
    assert K.SUPPORT_CASE_TYPES == ("support request", "service request")
    assert K.EMPTY_TOKENS == ("", "Unspecified", "None", "null", "NA")
    assert (K.TOP_ACCOUNTS, K.ACTIVE_ACCOUNT_MIN_TICKETS, K.ACCOUNT_LABEL_LENGTH, K.TOP_CAUSES, K.TOP_WORDS) == (10, 5, 15, 5, 100)
