import random

from compare import SF
from pyspark.sql import functions as F

from stratafold.llm import line_dedup
from stratafold.llm.line_dedup import align, leaving, units_of

LEAST, MOVED = 5, 20


def lines(text):
    return [(i, x.strip(), len(x.split())) for i, x in enumerate((text or "").split("\n")) if x.split()]


def units(text, least=LEAST):
    """(first rank, lines) of every shortest run of lines with ``least`` words, from each line on and up to each line."""
    rows, found = lines(text), set()
    count = lambda a, b: sum(w for _, _, w in rows[a:b])
    for a in range(len(rows)):
        ends = [b for b in range(a + 1, len(rows) + 1) if count(a, b) >= least]
        found |= {(a, min(ends))} if ends else set()
    for b in range(1, len(rows) + 1):
        starts = [a for a in range(b) if count(a, b) >= least]
        found |= {(max(starts), b)} if starts else set()
    return [(a, tuple(x for _, x, _ in rows[a:b])) for a, b in sorted(found)]


def patience(pairs, lo=(0, 0), hi=(10**9, 10**9)):
    """Matched places by a patience diff of a rectangle: unique pairs, a longest chain by dynamic programming, growth, gaps."""
    inside = {(i, j) for i, j in pairs if lo[0] <= i < hi[0] and lo[1] <= j < hi[1]}
    if not inside:
        return set()
    chain = sorted((i, j) for i, j in inside if sum(a == i for a, _ in inside) == 1 == sum(b == j for _, b in inside))
    if chain:
        length, back = [], []
        for k, (_, j) in enumerate(chain):
            length.append(1 + max([length[x] for x in range(k) if chain[x][1] < j], default=0))
            back.append(max([x for x in range(k) if length[x] == length[k] - 1], default=None))
        at, path = max(k for k in range(len(chain)) if length[k] == max(length)), []
        while at is not None:
            path.append(chain[at])
            at = back[at] if length[at] > 1 else None
        chain = path[::-1]
    else:
        run = lambda x: next(n for n in range(1, 10**6) if (x[0] + n, x[1] + n) not in inside)
        chain = [max(inside, key=lambda x: (run(x), -x[0], -x[1]))]
    out, edge = set(), lo
    blocks = []
    for i, j in chain:
        if i < edge[0] or j < edge[1]:
            continue
        a, b = (i, j), (i, j)
        while a[0] > edge[0] and a[1] > edge[1] and (a[0] - 1, a[1] - 1) in inside:
            a = (a[0] - 1, a[1] - 1)
        while (b[0] + 1, b[1] + 1) in inside:
            b = (b[0] + 1, b[1] + 1)
        edge = (b[0] + 1, b[1] + 1)
        blocks.append((a, edge))
        out |= {(a[0] + k, a[1] + k) for k in range(edge[0] - a[0])}
    for (_, start), (end, _) in zip([(lo, lo), *blocks], [*blocks, (hi, hi)]):
        out |= patience(inside, start, end)
    return out


def by_brute_force(texts):
    """The places of the lines that leave each document, pair by pair: all places of the shared lines in both texts."""
    first = {}
    for doc in sorted(texts):
        for _, run in units(texts[doc]):
            first.setdefault(run, doc)
    out = {}
    for doc in texts:
        rows, shared, pairs = lines(texts[doc]), {}, {}
        for _, run in units(texts[doc]):
            if first[run] < doc:
                shared.setdefault(first[run], set()).add(run)
        for holder, runs in shared.items():
            covered = lambda text: {(a + k, run[k]) for a, run in units(text) if run in runs for k in range(len(run))}  # noqa: E731, B023
            theirs = covered(texts[holder])
            pairs[holder] = {(i, j) for i, x in covered(texts[doc]) for j, y in theirs if x == y}
        for same in pairs.values():
            matched = patience(same)
            mine, theirs = {i for i, _ in matched}, {j for _, j in matched}
            rest = {(i, j) for i, j in same if i not in mine}
            gone = mine | {i for i, j in rest if j in theirs}
            for i, j in rest:
                if (i - 1, j - 1) not in rest:
                    n = next(n for n in range(1, 10**6) if (i + n, j + n) not in rest)
                    if sum(w for _, _, w in rows[i : i + n]) >= MOVED:
                        gone |= set(range(i, i + n))
            if gone:
                out.setdefault(doc, set()).update(rows[i][0] for i in gone)
    return out


def places(docs):
    return {r["doc_id"]: set(r["gone"]) for r in line_dedup.deletions(docs).collect()}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    gone = places(docs)
    assert gone == by_brute_force(texts) and gone
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got == {d: t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in texts.items()}


def test_shuffled_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"{k}w{i}" for i in range(rng.choice((1, 2, 3, 6, 9, 15)))) for k in range(40)]
    texts = {d: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for d in range(120)}
    texts |= {200 + d: "\n".join(rng.sample(texts[d].split("\n"), len(texts[d].split("\n")))) for d in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert places(docs) == by_brute_force(texts)


def test_hot_lines(spark):
    """A line that a third of all documents hold goes the way of broadcast keys and comes out the same."""
    hot = " ".join(f"hot{i}" for i in range(9))
    rows = [(i, f"own{i} a b c d e f\n" + (hot if i % 3 == 0 else f"other{i} a b c d e f")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert places(docs) == {i: {1} for i in range(3, 3000, 3)}


def test_passages_leave_later_documents(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, parts, short = say(60), [say(8), say(9), say(7)], say(4)
    rows = [(i, "\n".join([say(30), short, passage, say(25)])) for i in range(0, 40)]
    rows += [(50, "\n".join([say(30), *parts, say(5)])), (51, "\n".join([*parts, say(40)])), (52, "\n".join([parts[0], say(30)])), (53, f"{short}\n{say(9)}")]
    rows += [(60, rows[0][1]), (61, None), (62, ""), (63, say(5)), (64, rows[0][1].replace("\n", "\n\n"))]
    docs = spark.createDataFrame([(i, t, "clash", 9) for i, t in rows], "doc_id long, text string, lines string, n_deleted int")
    out = line_dedup.dedup(docs).collect()
    got = {r["doc_id"]: r["text"] for r in out}
    assert all(r["lines"] == "clash" for r in out) and out[0].asDict().keys() == {"doc_id", "text", "lines", "n_deleted"}
    assert passage in got[0] and not any(passage in (got[i] or "") for i in range(1, 70) if i in got)
    assert not any(short in got[i] for i in range(1, 40)) and short in got[0]  # beside the passage it is part of the block
    assert got[53] == rows[43][1] and parts[0] not in got[52]  # alone it pairs nothing
    assert all(p not in got[51] for p in parts) and got[50] == rows[40][1]
    assert not got[60].split() and got[61] is None and got[62] == "" and not got[64].split()


def test_repeated_rows_and_empty_table(spark):
    text, other = " ".join(f"a{i}" for i in range(30)), "\n".join(f"{x} one two three four" for x in "bcd")
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text), (2, other), (None, text), (3, other)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup(rows).collect())
    assert got == [(0, text), (1, text), (1, text), (2, ""), (2, ""), (2, other), (3, "")]
    assert line_dedup.dedup(rows.limit(0)).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    out = line_dedup.dedup(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_deleted"] and out.count() == odd_docs.count() and line_dedup.dedup(no_docs).count() == 0
    changed = {r["doc_id"]: r["text"] for r in out.filter("n_deleted > 0").collect()}
    assert changed == {5: "", 7: ""} or changed == {7: ""}
    assert out.filter(F.col("doc_id").isNull()).first()["text"] == "null id text"


def test_alignment():
    put = lambda text: {i: x for i, x in enumerate(text) if x != "-"}
    assert align(put("abcxy"), put("abc-xy")) == [(0, 0, 3), (3, 4, 2)]
    assert align(put("pqrxy"), put("xy-pqr")) == [(0, 3, 3)] and align({}, {}) == []
    assert align(put("faz"), put("afaz")) == [(0, 1, 3)] and align(put("aaaa"), put("aa-aaa")) == [(0, 3, 3)]
    assert leaving(put("pqrxy"), put("xy-pqr"), dict.fromkeys(range(5), 3), 20) == {0, 1, 2}  # a short moved block stays
    assert leaving(put("pqrxy"), put("xy-pqr"), dict.fromkeys(range(5), 10), 20) == {0, 1, 2, 3, 4}
    assert leaving(put("a-a"), put("a"), dict.fromkeys(range(3), 5), 20) == {0, 2}  # a copy of an aligned line goes with it
    # Texts of one line over and over stay linear.
    assert align(dict.fromkeys(range(30_000), 7), dict.fromkeys(range(20_000), 7)) == [(0, 0, 20_000)]


def test_a_repeated_line_does_not_break_its_block(spark):
    say = lambda x: " ".join(f"{x}{i}" for i in range(8))
    f, a, z, own = map(say, "fazo")
    docs = spark.createDataFrame([(1, "\n".join([a, f, a, z])), (2, "\n".join([f, a, z, own])), (3, "\n".join([a, f, a, z, f]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in line_dedup.dedup(docs).collect()}
    assert got == {1: (0, "\n".join([a, f, a, z])), 2: (3, own), 3: (5, "")}


def test_units_and_scripts_without_spaces(spark):
    assert [(ranks, pos) for ranks, _, _, pos, _, _ in units_of("a b\n\nc d\ne f g\nh", 5)] == [([0], [0, 2, 3]), ([1], [2, 3]), ([1], [2, 3, 4])]
    assert [(ranks, pos, len(x)) for ranks, _, _, pos, _, x in units_of("a b c d e\nx\na b c d e", 5)][0] == ([0, 2], [0, 2], 1)
    passage, own = " ".join(f"a{i}" for i in range(30)), [" ".join(f"{x}{i}" for i in range(25)) for x in "bcde"]
    han, thai = "".join(chr(0x4E00 + i) for i in range(60)), "".join(chr(0x0E01 + i % 40) for i in range(90))
    rows = [(1, f"{passage}\n{own[0]}\nshared line of five words\n{own[1]}"), (2, f"{passage}\n{own[2]}\nshared line of five words\n{own[3]}")]
    rows += [(3, f"{han}\n{thai}"), (4, f"{own[0][::-1]}\n{han}"), (5, thai + "\nend")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == f"{own[2]}\n{own[3]}" and got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[4] == own[0][::-1] and got[5] == "end"
