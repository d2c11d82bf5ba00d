import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import SF

from stratafold.llm import ngram_join
from stratafold.llm.text import ASCII_LOWER


def by_hand(rows, percent=80):
    """(doc_id, n_shingles, component_id) of every row; rows of one doc_id are one node."""
    sets, inverted = [], defaultdict(set)
    for i, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
        for s in sets[i]:
            inverted[s].add(i)
    label = {d: {d} for d, _ in rows}
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in inverted[x]).items():
            d, e = rows[i][0], rows[j][0]
            if 100 * n >= percent * (len(s) + len(sets[j]) - n) and label[d] is not label[e]:
                whole = label[d] | label[e]
                for x in whole:
                    label[x] = whole
    return sorted((d, len(s), min(label[d])) for (d, _), s in zip(rows, sets))


def found(docs):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs).collect())


def near_copies(seed, groups, size, edits):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(6, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_repeated_doc_ids_keep_the_links_of_all_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (5, a + " z"), (5, b), (7, b + " z"), (9, "one"), (9, "two three"), (11, "two three"), (11, None), (12, "one"), (13, ""), (5, b), (5, b)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == by_hand(rows) and {c for d, _, c in got if d in (1, 5, 7)} == {1} and {c for d, _, c in got if d in (9, 11, 12)} == {9}
    rng = random.Random(6)
    rows = [(rng.randrange(60), t) for _, t in near_copies(2, 12, 8, 6)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_cells_strung_together_by_chance(spark, monkeypatch):
    """Families of near copies and unrelated texts, each of which shares a rare passage with the next, form one cell."""
    rng = random.Random(9)
    rows = near_copies(11, 5, 25, 5)
    chain = [" ".join(f"c{k}x{i}" for i in range(9)) for k in range(len(rows) + 60)]
    rows = [(d, f"{t} {chain[d]} {chain[d + 1]}") for d, t in rows]
    rows += [(d, " ".join([*(f"u{d}y{i}" for i in range(30)), chain[d], chain[d + 1]])) for d in range(len(rows), len(rows) + 50)]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    monkeypatch.setattr(ngram_join.cell_links, "__defaults__", (700,))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_documents_with_a_common_line_are_no_cell(spark, monkeypatch):
    """Short documents of own words and a line that many hold: only near copies meet, however many hold the line."""
    rng, rows = random.Random(3), []
    lines = [" ".join(f"line{k}x{i}" for i in range(14)) for k in range(3)]
    for i in range(300):
        rows.append((len(rows), " ".join([*(f"u{i}y{j}" for j in range(12)), rng.choice(lines)])))
        if i % 15 == 0:
            rows.append((len(rows), rows[-1][1] + " more"))
    cells, cell_links = [], ngram_join.cell_links
    monkeypatch.setattr(ngram_join, "cell_links", lambda members, *more: cells.extend(r["cell"] for r in members.collect()) or cell_links(members, *more))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)
    assert len(cells) == 40 and set(Counter(cells).values()) == {2}


def test_block_of_unlinked_documents_counts_no_intersections(monkeypatch):
    """Documents that hold too few shingles of others are not compared, whatever they have in common."""
    sets = [np.unique(np.append(np.arange(30, dtype=np.uint64), np.arange(1000 * i + 1000, 1000 * i + 1012, dtype=np.uint64))) for i in range(200)]
    calls, bincount = [], np.bincount
    monkeypatch.setattr(ngram_join.np, "bincount", lambda *a, **k: calls.append(1) or bincount(*a, **k))
    assert ngram_join.block_links(sets, 80) == [] and len(calls) < 5


def test_voronoi_regions_hold_every_link(spark):
    """Any two documents within the radius meet in a region or are both left, with fewer copies than documents times pivots."""
    rng = random.Random(1)
    sets = []
    for f in range(6):
        base = [f * 1000 + i for i in range(60)]
        for _ in range(30):
            share = rng.random() * 0.5  # some close to their family, some far from it
            sets.append(frozenset(rng.randrange(10**6) if rng.random() < share else x for x in base))
    d = lambda x, y: 1 - len(x & y) / len(x | y)
    pivots = range(0, 180, 23)
    near = [(1, i, i, p, d(sets[i], sets[p])) for i in range(len(sets)) for p in pivots]
    got = ngram_join.voronoi(spark.createDataFrame(near, "cell long, doc_id long, s1 long, pivot long, d double"), 80).collect()
    where = defaultdict(set)
    for r in got:
        where[r["doc_id"]].add(r["pivot"])
    links = [(i, j) for i in range(len(sets)) for j in range(i) if d(sets[i], sets[j]) <= 0.2]
    assert len(links) > 50 and all(where[i] & where[j] for i, j in links) and len(where) == len(sets)
    assert len(got) < len(sets) * len(pivots) / 2 and len({p for x in where.values() for p in x}) > 3


@pytest.mark.parametrize("block", [1_500_000, 900])
def test_groups_of_near_copies_in_small_and_split_cells(spark, monkeypatch, block):
    rows = near_copies(4, 8, 20, 4)
    monkeypatch.setattr(ngram_join.cell_links, "__defaults__", (block,))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = ngram_join.components(odd_docs).collect()
    assert len(rows) == odd_docs.count() and ngram_join.components(no_docs).count() == 0
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert (got[1], got[2], got[3]) == ((0, 1), (0, 2), (0, 3)) and got[4] == (1, 4) and got[5] == (1, 4) and got[7][1] == 6 and got[8][1] == 8


@pytest.mark.parametrize("seed", range(5))
def test_block_links_equal_all_pairs(seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(40):
        base = sets[rng.randrange(len(sets))] if sets and rng.random() < 0.7 else np.unique(np.array([rng.randrange(10**6) for _ in range(30)], np.uint64))
        keep = base[np.array([rng.random() > 0.05 for _ in base])]
        sets.append(np.unique(np.append(keep, np.array([rng.randrange(10**6) for _ in range(rng.randint(0, 3))], np.uint64))))
    links = ngram_join.block_links(sets, 80)
    assert len(links) < len(sets)

    def label(pairs):
        of = list(range(len(sets)))
        for a, b in pairs:
            of = [of[a] if x == of[b] else x for x in of]
        return [of.index(x) for x in of]

    every = [(a, b) for a in range(40) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert label(links) == label(every)
