"""Line dedup by pairwise alignment.

Lines with words are hashed (128 bits). A unit is a shortest run of such lines with at
least ``min_words`` words: mostly a single line, a few lines where lines are short. From
every line a unit starts, and at every line one ends, so that a block of lines with that
many words is made of units. Every unit names its first holder, the smallest doc_id, and a
later document is paired with the first holders of its units. Most units are rare; one held
by n documents gives n - 1 pairs, not all of them, so none is too common to be followed.

Each pair is aligned with patience diff over the lines of the units it shares, at all their
places in both: lines that are unique in both are matched in a longest increasing order,
matches grow over equal neighbours, and the gaps between are aligned in the same way (where
no line is unique, by the longest common run, which a suffix automaton finds in linear
time). Every aligned block leaves the later document, and so do further
copies of an aligned line in it. Shared lines out of that order are moved text: a run of them
leaves if it has at least ``moved_words`` words and stays otherwise. First holders keep
theirs. Runs of fewer than ``min_words`` words never pair documents. Scripts written without
spaces count a word for two (Han, kana) or four (Thai, Lao, Burmese, Khmer) characters.

Scale: units are written once, a unit that repeats in a document as one row. A pair is made
of the hashes and places of its units' lines only: neither the other lines of a popular first
holder nor any text goes to its pairs. The join on units broadcasts
the few that hold more than a thousandth of all places. A document's own lines are the
largest thing a task holds. The text is shuffled once, in the last join, whatever its size.

Defined results: null and empty text stays as it is, as does a row without doc_id; rows that
repeat a doc_id are never compared with each other; lines within one document are never
compared; an empty table gives no rows; other columns are kept as they are, but for
n_deleted, which is replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.skew import heavy_join
from stratafold.scratch import discard, materialize

_HAN = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_THAI = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
#: One row per document and unit: the ranks at which it starts, the places of its lines there one after the other, and of each line words and hash.
UNITS = "doc_id long, tie long, ranks array<int>, r1 long, r2 long, pos array<int>, words array<int>, lines array<long>"


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def n_words(line: str) -> int:
    """Number of words, by white space and, in scripts without it, by characters."""
    if line.isascii():
        return len(line.split())
    line, han = _HAN.subn(" ", line)
    line, thai = _THAI.subn(" ", line)
    return len(line.split()) + -(-han // 2) + -(-thai // 4)


def units_of(text: str | None, min_words: int) -> list[tuple]:
    """(ranks, r1, r2, pos, words, lines) of every unit: ranks count the lines with words, pos all lines."""
    lines = [(pos, words, line) for pos, line in enumerate((text or "").split("\n")) if (words := n_words(line))]
    digests = [hashlib.md5(line.strip().encode("utf-8", "surrogatepass")).digest() for _, _, line in lines]
    spans, end, total = set(), 0, 0
    for start in range(len(lines)):  # shortest runs from every line on
        while end < len(lines) and total < min_words:
            total += lines[end][1]
            end += 1
        if total < min_words:
            break
        spans.add((start, end))
        total -= lines[start][1]
    start, total = 0, 0
    for end in range(1, len(lines) + 1):  # shortest runs up to every line
        total += lines[end - 1][1]
        while total - lines[start][1] >= min_words:
            total -= lines[start][1]
            start += 1
        if total >= min_words:
            spans.add((start, end))
    out: dict[bytes, tuple] = {}
    for a, b in sorted(spans):
        digest = digests[a] if b == a + 1 else hashlib.md5(b"".join(digests[a:b])).digest()
        unit = out.setdefault(digest, ([], *_halves(digest), [], [x[1] for x in lines[a:b]], [_halves(d)[0] for d in digests[a:b]]))
        unit[0].append(a)
        unit[3].extend(x[0] for x in lines[a:b])
    return list(out.values())


def unit_table(docs: DataFrame, min_words: int) -> DataFrame:
    """The rows of UNITS of all documents; ``tie`` tells texts of one doc_id apart."""
    fields = [x.split() for x in UNITS.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}[t]) for n, t in fields])

    def run(batches):
        for batch in batches:
            held: list[tuple] = []
            for doc, tie, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                held += [(doc.as_py(), tie.as_py(), *row) for row in units_of(text.as_py(), min_words)]
                if len(held) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    rows = docs.filter("doc_id is not null and text is not null")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").mapInArrow(run, UNITS)


def _increasing(places: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    ends, at, back = [], [], [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        if k == len(ends):
            ends.append(p)
            at.append(i)
        else:
            ends[k], at[k] = p, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


class _Runs:
    """A suffix automaton over numbered lines: the runs of neighbours in it, found in linear time."""

    def __init__(self, numbers: list[int], ids: list[int]):
        self.step, self.link, self.length, self.end = [{}], [-1], [0], [-1]
        last, before = 0, None
        for number, line in zip(numbers, ids):
            if before is not None and number != before + 1:  # a gap: nothing runs over it
                last = self._add(last, ("gap", number), -1)
            last, before = self._add(last, line, number), number

    def _state(self, step: dict, link: int, length: int, end: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.step) - 1

    def _add(self, last: int, line, number: int) -> int:
        new, at = self._state({}, 0, self.length[last] + 1, number), last
        while at >= 0 and line not in self.step[at]:
            self.step[at][line] = new
            at = self.link[at]
        if at >= 0:
            old = self.step[at][line]
            if self.length[old] > self.length[at] + 1:
                twin = self._state(dict(self.step[old]), self.link[old], self.length[at] + 1, self.end[old])
                while at >= 0 and self.step[at].get(line) == old:
                    self.step[at][line] = twin
                    at = self.link[at]
                self.link[old] = twin
                old = twin
            self.link[new] = old
        return new

    def along(self, numbers: list[int], ids: list[int]):
        """For every line of another document: the length of the longest run that ends there and stands here, and where it first ends here."""
        state, length, before = 0, 0, None
        for number, line in zip(numbers, ids):
            if before is None or number != before + 1:
                state, length = 0, 0
            while state and line not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if line in self.step[state]:
                state, length = self.step[state][line], length + 1
            before = number
            yield length, self.end[state]


def align(mine: dict[int, int], theirs: dict[int, int]) -> list[tuple[int, int, int]]:
    """Blocks (i, j, length) of a patience diff of two documents, given by the places and hashes of lines."""
    blocks, todo = [], [(sorted(mine), sorted(theirs))]
    while todo:
        own, other = todo.pop()
        here, there = Counter(mine[i] for i in own), Counter(theirs[j] for j in other)
        own = [i for i in own if mine[i] in there]
        other = [j for j in other if theirs[j] in here]
        if not own:
            continue
        once = {theirs[j]: j for j in other if there[theirs[j]] == 1}
        anchors = [(i, once[mine[i]]) for i in own if here[mine[i]] == 1 and mine[i] in once]
        if anchors:
            anchors = [anchors[k] for k in _increasing([j for _, j in anchors])]
        else:
            runs = _Runs(other, [theirs[j] for j in other])
            ended = [(-n, i - n + 1, j - n + 1) for i, (n, j) in zip(own, runs.along(own, [mine[i] for i in own]))]
            anchors = [min(ended)[1:]]
        ours, others = set(own), set(other)
        same = lambda i, j: i in ours and j in others and mine[i] == theirs[j]
        found: list[tuple[int, int, int]] = []
        for i, j in anchors:
            end_i, end_j = (found[-1][0] + found[-1][2], found[-1][1] + found[-1][2]) if found else (-1, -1)
            if i < end_i or j < end_j:
                continue
            n = 1
            while same(i + n, j + n):
                n += 1
            while i > end_i and j > end_j and same(i - 1, j - 1):
                i, j, n = i - 1, j - 1, n + 1
            found.append((i, j, n))
        blocks += found
        # The gaps before, between and after the blocks; what lies out of order is left.
        edges = [(-1, -1, 0), *found, (1 << 60, 1 << 60, 0)]
        a = b = 0
        for (i, j, n), (next_i, next_j, _) in zip(edges, edges[1:]):
            a, b = bisect_left(own, i + n, a), bisect_left(other, j + n, b)
            gap = own[a : bisect_left(own, next_i, a)], other[b : bisect_left(other, next_j, b)]
            if gap[0] and gap[1]:
                todo.append(gap)
    return sorted(blocks)


def leaving(mine: dict[int, int], theirs: dict[int, int], words: dict[int, int], moved_words: int) -> set[int]:
    """The places of the later document (place to line hash) whose lines leave it, of those it shares with the first holder."""
    blocks = align(mine, theirs)
    aligned = {i + k for i, _, n in blocks for k in range(n)}
    copied = {mine[i] for i in aligned}
    gone = aligned | {i for i, line in mine.items() if line in copied}
    rest = [i for i in sorted(mine) if i not in aligned]
    if rest and sum(words[i] for i in rest) >= moved_words:
        other = sorted(theirs)
        runs = _Runs(other, [theirs[j] for j in other])
        before = dict(zip(rest, accumulate((words[i] for i in rest), initial=0)))
        done = -1
        for i, (n, _) in zip(rest, runs.along(rest, [mine[i] for i in rest])):
            if n and before[i] + words[i] - before[i - n + 1] >= moved_words:
                gone.update(range(max(done + 1, i - n + 1), i + 1))
                done = i
    return gone


def deletions(docs: DataFrame, min_words: int = 5, moved_words: int = 20) -> DataFrame:
    """doc_id, tie (hash of the text), gone: the places of the lines that leave each later document, where there are any."""
    units = materialize(unit_table(docs, min_words), "units")
    firsts = units.groupBy("r1", "r2").agg(
        F.min(F.struct("doc_id", "tie", "ranks")).alias("f"), F.max("doc_id").alias("last"), F.count("*").alias("held")
    ).filter("f.doc_id < last")
    shared = materialize(firsts.select("r1", "r2", "held", F.col("f.doc_id").alias("first"), F.col("f.tie").alias("first_tie"), F.col("f.ranks").alias("places")), "shared")
    later = heavy_join(units, shared, ["r1", "r2"], "held", units.count()).filter("doc_id > first")
    pairs = later.groupBy("doc_id", "tie", "first", "first_tie").agg(F.collect_list(F.struct("ranks", "places", "pos", "words", "lines")).alias("units"))

    def work(batches):
        for pdf in batches:
            out = []
            for doc, tie, units in zip(pdf["doc_id"], pdf["tie"], pdf["units"]):
                places, words, mine, theirs = {}, {}, {}, {}
                for u in units:
                    lines, weights, pos = (u[n].tolist() for n in ("lines", "words", "pos"))
                    for at, start in enumerate(u["ranks"].tolist()):
                        for k, line in enumerate(lines):
                            mine[start + k], words[start + k], places[start + k] = line, weights[k], pos[at * len(lines) + k]
                    for start in u["places"].tolist():
                        theirs.update((start + k, line) for k, line in enumerate(lines))
                out.append((doc, tie, sorted(places[i] for i in leaving(mine, theirs, words, moved_words))))
            yield pd.DataFrame(out, columns=["doc_id", "tie", "gone"])

    found = pairs.select("doc_id", "tie", "units").mapInPandas(work, "doc_id long, tie long, gone array<int>")
    gone = found.groupBy("doc_id", "tie").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    gone = materialize(gone.filter(F.size("gone") > 0), "gone")
    discard(units, shared)
    return gone


def dedup(docs: DataFrame, min_words: int = 5, moved_words: int = 20) -> DataFrame:
    """The documents with the aligned blocks deleted, and n_deleted, the number of deleted lines."""
    gone = deletions(docs, min_words, moved_words).hint("merge")
    rows = docs.select(F.struct("*").alias("row"))
    same = (rows["row.doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(rows["row.text"]) == gone["tie"])
    rows = rows.join(gone, same, "left")
    # The lines between one place that leaves and the next: linear in the lines.
    lines = F.split("row.text", "\n")
    ends = F.concat("gone", F.array(F.size(lines)))
    kept = F.flatten(F.transform(ends, lambda end, i: F.slice(lines, F.when(i == 0, 1).otherwise(F.get("gone", i - 1) + 2), end - F.when(i == 0, 0).otherwise(F.get("gone", i - 1) + 1))))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("text")
    columns = [text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_deleted"]
    return rows.select(*columns, F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_deleted"))
