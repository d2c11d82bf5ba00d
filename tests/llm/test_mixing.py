import math
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from stratafold.llm import mixing


def fill(sizes, weights=(5, 2, 1), cap=3.0):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not above:
            return target | share
        for s in above:
            target[s] = cap * sizes[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    source = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in docs.collect()}
    assert len(rows) == len(source) and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    sizes, taken = {}, {}
    for r in rows:
        s = source[r["doc_id"]][0]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = fill(sizes)
    for r in rows:
        s = source[r["doc_id"]][0]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_caps_and_skew(spark):
    rows = [(i, "w " * 50, "a") for i in range(4)] + [(10 + i, "w " * 40, "hot") for i in range(300)] + [(900, "x " * 5000, "z"), (901, None, "z"), (902, "", None)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, skey string, block long")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    want = fill({"a": 200, "hot": 12000, "z": 5000, None: 0})
    assert got[0]["target"] == pytest.approx(600) == pytest.approx(want["a"]) and all(got[i]["taken"] == 150 for i in range(4))
    assert abs(sum(got[10 + i]["taken"] for i in range(300)) - want["hot"]) <= 1 and abs(got[900]["taken"] - want["z"]) <= 1
    assert got[902]["target"] == 0 == got[902]["taken"] and got[901]["taken"] == 0


@pytest.mark.parametrize("sizes", [{"a": [130], "b": [130]}, {"a": [300], "b": [140]}, {"a": [1000], "b": [1300], "c": [260]}, {"a": [100] * 10, "b": [13] * 100, "c": [52] * 5}, {"a": [1], "b": [7, 0, 2]}])
def test_small_sources_meet_their_targets(spark, sizes):
    rows = [(100 * i + k, "w " * n, s) for i, (s, of) in enumerate(sizes.items()) for k, n in enumerate(of)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want, taken = fill({s: sum(of) for s, of in sizes.items()}), dict.fromkeys(sizes, 0)
    for r in got:
        taken["abc"[r["doc_id"] // 100]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert all(want[s] - 1 < taken[s] <= want[s] + 1e-6 for s in sizes), (taken, want)


def test_missing_and_repeated_ids_are_spread_over_chunks(spark):
    rows = [(None if i % 2 else 7, f"{'w ' * (i % 50)}x{i if i % 4 else 0}", "a") for i in range(6000)]
    plan = mixing.Plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), (5, 2, 1), 3.0, 128, 8192, 256, 7)
    held = [r["n"] for r in plan.rows.groupBy("chunk").agg(F.sum("copies").alias("n")).collect()]
    assert sum(held) == 6000 and len(held) == 24 and max(held) < 500


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and mixing.mix(no_docs).count() == 0
    assert all(r["taken"] <= 3 * r["size"] for r in rows)


def test_shards_hold_the_tokens_that_are_counted(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(37 * i % 400)), "ab"[i % 2]) for i in range(60)] + [(100, None, "a"), (101, "one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slots = mixing.mixed(docs, block_tokens=16, shard_slots=50).collect()
    held, source = {}, {w: s for _, t, s in rows for w in (t or "").split()}
    for r in slots:
        words = r["tokens"].split(" ")
        assert len(words) == r["n_tokens"] <= 16 and {source[w] for w in words} == {r["source"]}
        for w in words:
            held[w] = held.get(w, 0) + 1
    assert len({r["shard"] for r in slots}) > 3 and len({(r["source"], r["slot"]) for r in slots}) == len(slots)
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block_tokens=16, shard_slots=50).collect()}
    assert got == {i: sum(held.get(w, 0) for w in (t or "").split()) for i, t, _ in rows} and sum(got.values()) > 5000


def hashed(*values):
    """Spark's xxhash64 of ints (as LiteralInt), longs and strings."""
    h = 42
    for v in values:
        if v is not None:
            raw = v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def literal(v):
    return struct.pack("<i", v)


def walked(j, n, key):
    a = math.ceil(math.sqrt(n))
    b = -(-n // a)
    while True:
        left, right = divmod(j, b)
        for r in range(mixing.ROUNDS):
            if r % 2:
                right = (right + hashed(*key, literal(r), left) % b) % b
            else:
                left = (left + hashed(*key, literal(r), right) % a) % a
        j = left * b + right
        if j < n:
            return j


def taken_by_brute_force(rows, block, chunk_docs, seed, cap=3.0):
    """taken of every row (doc_id, text, source), slot by slot and token by token."""
    sized = [(d, len((t or "").split()), hashed(t), s) for d, t, s in rows]
    sizes, docs = {}, {}
    for _, n, _, s in sized:
        sizes[s], docs[s] = sizes.get(s, 0) + n, docs.get(s, 0) + 1
    target, out = fill(sizes, cap=cap), []
    for s in sizes:
        key, chunks, met = ("s" + s if s is not None else "n"), {}, {}
        for row in sorted((x for x in sized if x[3] == s), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:3])):
            lot = met.get(row, 0) // mixing.COPIES
            met[row] = met.get(row, 0) + 1
            chunks.setdefault(hashed(row[0], row[2], row[1], lot, literal(17)) % math.ceil(docs[s] / chunk_docs), []).append(row)
        order = [(c, i) for c in sorted(chunks) for i in range(len(chunks[c]))]
        stream = [x for x in order for _ in range(chunks[x[0]][x[1]][1])]
        blocks = [stream[i : i + block] for i in range(0, len(stream), block)]
        took, left, k = dict.fromkeys(order, 0), math.floor(target[s] + 1e-6), 0
        full = len(stream) // block
        while left > 0:
            j = k % len(blocks)
            for token in blocks[walked(j, full, (literal(seed), key)) if j < full else j][:left]:
                took[token] += 1
                left -= 1
            k += 1
        out += [(chunks[c][i][0] or -1, chunks[c][i][1], n) for (c, i), n in took.items()]
    return sorted(out)


def test_taken_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
    odd = [(10**6 + i, "w " * (7 * i % 60), "ab"[i % 2]) for i in range(90)] + [(5, "x y z", None), (5, "x y z", None), *[(8, "s t", "b")] * 150, (None, "u v w", "a"), (None, "u", "a"), (6, None, "b"), (7, "", "c")]
    for some, block, chunk_docs in ((rows, 128, 2048), (rows + odd, 16, 20), (odd, 7, 5)):
        docs = spark.createDataFrame(some, "doc_id long, text string, source string")
        got = mixing.mix(docs, block_tokens=block, chunk_docs=chunk_docs).collect()
        assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got) == taken_by_brute_force(some, block, chunk_docs, 7)


def test_permutation_and_many_sources(spark, monkeypatch):
    for n in (1, 2, 3, 7, 16, 17, 100, 289, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(3), F.lit("s")]).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n)) and (n < 50 or [r["p"] for r in got] != list(range(n)))
    docs = spark.createDataFrame([(i, "w " * (i % 40), f"src{i % 30}") for i in range(300)], "doc_id long, text string, source string")
    few = sorted(map(tuple, mixing.mix(docs, block_tokens=8).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    assert sorted(map(tuple, mixing.mix(docs, block_tokens=8).collect())) == few
