"""One search for all terms against one count per term."""

import random
import re

import pytest

from ticketlab import constants as K
from ticketlab.operators import issues
from ticketlab.operators.issues import IssueConfig, trie_pattern

OVERLAPPING = (r"data\s*quality", r"data\s*quality\s*check", r"wrong\s*data", r"sync\s*issue", r"synchronization", r"data\s*sync", r"check\s*in",
               r"data\s*qualitycheck\s*list")


def frame(spark, texts):
    return spark.createDataFrame([(t, t[::-1] if t else None) for t in texts], "subject string, description string")


def texts(seed, terms, n):
    r = random.Random(seed)
    words = sorted({w for t in terms for w in t.split(r"\s*")}) + ["x", "DATA", "Wrong", "qualitÿ", "ſync", "chec"]
    gaps = ["", " ", "  ", "\t", "\n", " ", "  ", "\x1c", "-", "​"]
    return ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(0, 30))) for _ in range(n)]


def rows(df):
    return {r.term: r.term_count for r in df.where("term_count > 0").collect()}


@pytest.mark.parametrize("terms", [K.DATA_QUALITY_TERMS, OVERLAPPING[:-1]])
def test_one_search_equals_one_count_per_term(spark, terms):
    cfg = IssueConfig(terms=terms, fields=("subject", "description"))
    df = frame(spark, texts(3, terms, 400) + ["wrong data quality check in", "Data Quality Check", "", None, "datadata quality", "data " * 5000 + "sync issue"])
    pattern = trie_pattern(terms)
    got = rows(issues.term_counts(df, pattern, cfg))
    assert got == rows(issues.term_counts_by_pattern(df, cfg)) == rows(issues.dq_terms(df, cfg)) and len(got) > 5


def test_python_counts(spark):
    """The original's own count, field texts joined by a space."""
    cfg = IssueConfig(fields=("subject", "description"))
    data = [t for t in texts(8, K.DATA_QUALITY_TERMS, 200) if "ſ" not in t and "​" not in t]
    want = {name: sum(len(re.findall(p, f"{t} {t[::-1] if t else ''}", re.IGNORECASE)) for t in data) for name, p in K.distinct_terms()}
    assert rows(issues.dq_terms(frame(spark, data), cfg)) == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("terms", [(r"data\s+quality",), ("a.c",), (r"ana\s*na", "x"), (r"sync\s*hot", "synchotel"), OVERLAPPING, ("",), ()])
def test_other_patterns_are_counted_one_by_one(terms):
    assert trie_pattern(terms) is None


def test_own_patterns(spark):
    cfg = IssueConfig(terms=("a.a", r"\d+", "ana"), fields=("subject",))
    got = rows(issues.dq_terms(frame(spark, ["banana 12 3", "ABA", None]), cfg))
    assert got == {"a.a": 2, r"\d+": 2, "ana": 1}


def test_plan_searches_the_text_once(spark):
    df = frame(spark, ["x"])
    plan = issues.dq_terms(df, IssueConfig(fields=("subject", "description")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "regexp_count" not in plan
