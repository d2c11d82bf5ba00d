"""Operator 12: blocks round trip, skipped blocks, and ranks against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stratafold.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def by_brute_force(docs, items, k=10):
    held = [(d, Counter(t), len(t)) for d, text in docs if (t := terms(text))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for doc, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, x[-1], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def prose(rng, n, words=300):
    return " ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(n))


@pytest.mark.parametrize("shard_docs", [1 << 16, 50])
def test_ranks_equal_brute_force(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(lexical, "FIRST_VISIT", 8)
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.choice([0, 3, 20, 90, 400]))) for i in range(600)] + [(1000 + i, "tie tie w1") for i in range(40)]
    items = [(i, prose(rng, rng.choice([1, 5, 40]))) for i in range(25)] + [(90, "TIE w1"), (91, "nowhere"), (92, None), (93, ""), (94, "tie tie tie")]
    d, q = frames(spark, docs, items)
    n_docs, n_terms = lexical.sizes(d)
    index = lexical.materialize(lexical.build(d.repartition(3), n_docs, n_terms, block=16), "index")
    queries = lexical.materialize(lexical.queries_of(q), "queries")
    expected = by_brute_force(docs, items)
    for query_bytes in (60, 1 << 20):  # several jobs, one job
        found = lexical.search(index, queries, n_docs, block=16, query_bytes=query_bytes).join(queries, "query")
        assert result(found) == expected
    assert result(lexical.ranked(d, q)) == expected


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one TWO three"), (1, "one TWO three"), (None, "mit license"), (3, None), (4, "日本語 word1"), (5, "id")], "item_id long, text string")
    docs, asked = [(r["doc_id"], r["text"]) for r in odd_docs.collect()], [tuple(r) for r in items.collect()]
    assert result(lexical.ranked(odd_docs, items)) == by_brute_force(docs, asked)
    assert result(lexical.ranked(no_docs, items)) == []
    assert result(lexical.ranked(odd_docs, items.limit(0))) == []


def shard_of(docs, block):
    shard = lexical._Shard()
    for i, text in enumerate(docs):
        shard.add(i, text.encode())
    table = shard.rows(0, len(shard.doc_ids), sum(shard.n_terms), block)
    own, table = table.slice(len(table) - 1), table.slice(0, len(table) - 1)
    lengths = np.array(own.column("lengths")[0].as_py())
    return table, lexical.Lists.of(table, lengths, np.arange(len(lengths)), block)


def test_blocks_give_back_every_posting():
    rng = random.Random(5)
    docs = [prose(rng, rng.randint(1, 60)) for _ in range(500)] + ["often " * 300, "often " * 70_000] + [f"x{i}" for i in range(70_000)] + ["w1 often"]
    table, lists = shard_of(docs, 32)
    held = [Counter(terms(d)) for d in sorted(docs, key=lambda d: len(terms(d)))]
    for i, term in enumerate(table.column("term").to_pylist()):
        if term.startswith("x") and term != "x5":
            continue
        blocks = np.arange(lists.first[i], lists.first[i + 1])
        found, tf = lists.open(np.full(len(blocks), i), blocks)
        assert list(zip(found.tolist(), tf.tolist())) == [(d, c[term]) for d, c in enumerate(held) if term in c]
        top = [lexical.impacts(np.array([held[d][term] for d in found[k : k + 32]]), lists.lengths[found[k : k + 32]]).max() for k in range(0, len(found), 32)]
        assert top == lists.tops[blocks].tolist()


def test_blocks_below_the_threshold_stay_closed():
    """A passage that stands in a few documents: most blocks of its common words are never opened."""
    rng = random.Random(7)
    docs = [prose(rng, rng.randint(1, 600), 2000) for _ in range(8_000)]
    passage = prose(rng, 40, 2000)
    docs += [f"{passage} only{i}" for i in range(12)]
    table, lists = shard_of(docs, lexical.BLOCK)
    at, df = {t: i for i, t in enumerate(table.column("term").to_pylist())}, table.column("n").to_numpy()
    asked = Counter(terms(passage))
    weights = [math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[at[t]] + 1))) * n for t, n in asked.items()]
    found, scores, blocks, opened = lists.best(np.array([at[t] for t in asked]), np.array(weights), 10)
    held = [Counter(terms(d)) for d in docs if "only" in d]
    assert len(found) == 10 and (lists.lengths[found] == lists.lengths[found[0]]).all() and len(held) == 12
    assert opened < 0.5 * blocks, (opened, blocks)
