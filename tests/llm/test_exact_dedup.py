"""Operator 13: the filter against a counter, the groups against brute force on odd rows and in hot groups."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafold.llm import exact_dedup
from stratafold.llm.quotient import CountingQuotientFilter as Filter


def counted(f):
    return dict(zip(*(x.tolist() for x in f.items())))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**20 - 1) | st.integers(0, 40), max_size=400), st.integers(1, 5))
def test_filters_lose_nothing_and_merge(values, parts):
    values = np.array(values, dtype=np.uint64)
    whole = Filter.loads(Filter.of(values, None, 20).dumps())
    assert counted(whole) == Counter(values.tolist())
    assert list(counted(whole)) == sorted(counted(whole))
    assert counted(Filter.merged([Filter.of(p, None, 20) for p in np.array_split(values, parts)])) == Counter(values.tolist())


def test_counts_of_any_size():
    counts = [1, 2, 1 << 16, (1 << 16) + 1, 1 << 40, 3]
    values = np.arange(len(counts), dtype=np.uint64) * np.uint64(7)
    assert counted(Filter.loads(Filter.build(values, np.array(counts), 20).dumps())) == dict(zip(values.tolist(), counts))


def by_brute_force(rows):
    """(doc_id, keep_id, group_size, kept, sha) as a multiset."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for normal, held in groups.items():
        sha = hashlib.sha256(normal.encode()).hexdigest()
        for i, (*_, doc) in enumerate(sorted(held)):
            out.append((doc, sorted(held)[0][-1], len(held), i == 0, sha))
    return sorted(out, key=str)


def result(df, **args):
    return sorted((tuple(r) for r in exact_dedup.dedup(df, **args).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_odd_rows(odd_docs, no_docs, few):
    assert result(odd_docs, few_repeated=few) == by_brute_force([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert result(no_docs, few_repeated=few) == []


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_a_group_of_a_third_of_the_rows(spark, few):
    rows = [(i, "the same  text" + " " * (i % 5)) if i % 3 == 0 else (i, f"text {i % 2000}" + "\n" * (i % 2)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(df, few_repeated=few) == by_brute_force(rows)


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    """With a fingerprint of two values, every group of a fingerprint holds different texts."""
    hashed = exact_dedup.F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: hashed(c) % 2)
    rows = [(i, f"text {i % 40}") for i in range(200)] + [(i, f"alone {i}") for i in range(200, 220)]
    for few in (0, 1 << 20):
        assert result(spark.createDataFrame(rows, "doc_id long, text string"), few_repeated=few) == by_brute_force(rows)
