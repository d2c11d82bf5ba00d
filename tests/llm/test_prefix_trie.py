"""Operator 11: nodes against a trie of dictionaries, with ranges cut at many places."""

import hashlib
import math
import random
import re
import zlib

import pytest

from stratafold.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, keys string, words long, node string, part int"


def by_brute_force(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv, []).append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members, ends = nodes.setdefault(seq[:d], ([], []))
            members.append(c)
            if d == len(seq):
                ends.append(c)
    out = []
    for prefix, (members, ends) in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(nodes[p][0]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        parent = min(nodes[prefix[:-1]][0]) if prefix else None
        sha = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
        out.append((min(members), len(prefix), parent, len(members), len(children), len(leaves), saved, sha))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "n", 2) for r in rows], SCHEMA)


def result(nodes):
    return sorted(map(tuple, nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


@pytest.fixture(scope="module")
def alike():
    """Conversations of few different turns, a third of them equal, some turnless once rebuilt."""
    rng, rows = random.Random(11), []
    for c in range(0, 400, 1):
        if c % 40 == 0:
            continue  # its group has no first conversation
        n = 3 if c % 3 == 0 else rng.randint(1, 5)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", "same words here" if c % 3 == 0 else rng.choice(["a b", "c", "", "d e f"])) for t in range(n)]
    return rows


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_nodes_equal_brute_force(spark, alike, parts, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        arrays = prefix_trie.rebuilt(prefix_trie.turn_arrays(frame(spark, alike)))
        assert result(prefix_trie.trie(arrays, chunk_ids=3)) == by_brute_force(alike)
        assert result(prefix_trie.conversation_trie(frame(spark, alike))) == by_brute_force(alike)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_names_lead_from_node_to_parent(spark, alike):
    nodes = {r["node"]: r for r in prefix_trie.conversation_trie(frame(spark, alike)).collect()}
    assert len(nodes) == len(by_brute_force(alike))
    for r in nodes.values():
        assert (r["parent"] is None) == (r["depth"] == 0)
        assert r["depth"] == 0 or (nodes[r["parent"]]["depth"], nodes[r["parent"]]["conv_id"]) == (r["depth"] - 1, r["parent_conv_id"])


def test_odd_rows(spark):
    long = "word " * 50_000
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, None, "", ""), (2, 0, "user", None), (2, 0, "user", ""), (3, 5, "u", "tie b"), (3, 5, "u", "tie a"),
        (None, 0, "user", "lost"), (-5, 1, "u", "x"), (20, 0, "u", long), (20, 1, "u", long), (21, 0, "u", long), (22, -1, "u", "é  x"), (0, 0, "ab", "c"), (4, 0, "a", "bc"),
    ] + [(7, t, "u", str(t)) for t in range(3000)]
    few = [r for r in rows if r[0] != 7 or r[1] < 12]
    assert result(prefix_trie.conversation_trie(frame(spark, few))) == by_brute_force(few)
    deep = result(prefix_trie.conversation_trie(frame(spark, rows)))
    assert max(r[1] for r in deep) >= 2997 and len(deep) == len(by_brute_force(few)) + 3000 - 12
    assert result(prefix_trie.conversation_trie(frame(spark, rows).limit(0))) == []
