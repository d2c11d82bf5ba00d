"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

``build`` writes an inverted index of all terms of all documents. Every task cuts its
documents into shards and numbers them by length; a shard has one row per term, whose
postings (document, frequency) lie in blocks of BLOCK postings. A block stores its first and
last document, the largest impact of its postings, and a body in which gaps and frequencies
take as few bytes as the block needs.

``search`` ranks all documents for each query. Within a shard the block maxima alone bound
the score of every document: between two block ends no pointer moves, so the sum of the
maxima of the blocks that lie there (times the weights of their terms) holds for the whole
range. All these shallow moves are made first, over first and last documents, and open no
block. Ranges are then visited from the largest bound down; each visit opens the blocks that
reach into its ranges, adds up the exact scores of their documents and raises the threshold,
the k-th best score so far. The first range with a bound below the threshold ends the
search: the blocks that lie only in such ranges are never decompressed. A range whose bound
equals the threshold is still visited, for ties go to the smaller doc_id. The best k of
each shard are merged.

Scores are in 64-bit integers; a term's weight needs its frequency over all shards, a
document's length factor the number and total length of all documents, which a first pass
counts.

Scale: the text is read twice and never shuffled; a shard is built from at most SHARD_BYTES
of text (one document may be longer) and SHARD_DOCS documents. A search reads the lists of
its terms, which are shuffled by shard; a shard's lists are bounded by the shard. Queries are
broadcast in blocks of QUERY_BYTES, whatever their number. A common term is as many lists as
there are shards. What a shard gives back is k rows a query.

Defined results: null and empty texts have no terms and are never found; a query without
terms, or whose terms no document holds, finds nothing; rows that repeat a doc_id are
documents of their own, rows that repeat an item_id queries of their own; a null doc_id
comes last among equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.scratch import discard, materialize

BLOCK = 128
#: Bytes of text, and documents, from which a shard is built.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Bytes of query terms that one job broadcasts.
QUERY_BYTES = 4 << 20
#: Documents in the ranges that the first visit of a search opens.
FIRST_VISIT = 256

#: One row per shard and term; the row without a term has the shard's documents: doc_ids and length factors.
INDEX = "shard long, term string, n long, starts array<int>, ends array<int>, tops array<long>, cuts array<int>, body binary, doc_ids array<long>, lengths array<long>"
_NAMES = [c.split()[0] for c in INDEX.split(", ")]

#: Lower-cases A-Z and turns every byte that belongs to no term into a space. Bytes of non-ASCII characters stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return (text or b"").translate(_TERM_BYTES).split()


def sizes(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have in all."""

    def count(batches):
        for batch in batches:
            lengths = [len(terms_of(x.as_py())) for x in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"docs": [sum(map(bool, lengths))], "terms": [sum(lengths)]})

    row = docs.select(F.col("text").cast("binary")).mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a posting adds to a score, for a weight of one."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * length)


class _Numbers(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Shard:
    """Documents on their way into one shard of the index."""

    def __init__(self):
        self.numbers, self.ids, self.tfs = _Numbers(), array("i"), array("i")
        self.doc_ids: list[int | None] = []
        self.n_terms, self.n_distinct, self.n_bytes = [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        terms = terms_of(text)
        if not terms:
            return
        held = Counter(terms)
        self.ids.extend(map(self.numbers.__getitem__, held))
        self.tfs.extend(held.values())
        self.doc_ids.append(doc_id)
        self.n_terms.append(len(terms))
        self.n_distinct.append(len(held))
        self.n_bytes += len(text)

    def full(self) -> bool:
        return self.n_bytes >= SHARD_BYTES or len(self.doc_ids) >= SHARD_DOCS

    def rows(self, shard: int, n_docs: int, n_terms: int, block: int) -> pa.Table:
        """The shard's rows of INDEX."""
        # By length, so that the documents of a block are alike and its maximum says much about each.
        by_length = np.argsort(np.array(self.n_terms), kind="stable")
        length = 25 + (75 * np.array(self.n_terms, dtype=np.int64)[by_length] * n_docs) // n_terms
        number = np.empty(len(by_length), dtype=np.int64)
        number[by_length] = np.arange(len(by_length))
        ids, doc = np.frombuffer(self.ids, dtype=np.int32), np.repeat(number, self.n_distinct)
        order = np.lexsort((doc, ids))
        doc = doc[order]
        tf = np.frombuffer(self.tfs, dtype=np.int32)[order].astype(np.int64)
        df = np.bincount(ids, minlength=len(self.numbers))
        # Blocks: where each begins among the postings, and how many each term has.
        per = -(-df // block)
        first_block = np.cumsum(per) - per
        of = np.repeat(np.arange(len(df)), per)
        begin = (np.cumsum(df) - df)[of] + (np.arange(len(of)) - first_block[of]) * block
        count = np.diff(np.append(begin, len(doc)))
        mine = np.repeat(np.arange(len(begin)), count)  # the block of each posting
        place = np.arange(len(doc)) - begin[mine]
        gap = np.where(place == 0, 0, np.diff(doc, prepend=0))
        tops = np.maximum.reduceat(impacts(tf, length[doc]), begin)
        # Bodies: a byte that tells the two widths, the gaps, the frequencies.
        gap_width, tf_width = _width(np.maximum.reduceat(gap, begin)), _width(np.maximum.reduceat(tf, begin))
        sizes = 1 + count * (gap_width + tf_width)
        cut = np.cumsum(sizes) - sizes
        body = np.zeros(int(sizes.sum()), dtype=np.uint8)
        body[cut] = gap_width * 16 + tf_width
        for values, width, base in ((gap, gap_width[mine], cut[mine] + 1), (tf, tf_width[mine], (cut + 1 + count * gap_width)[mine])):
            for k in range(4):
                has = width > k
                body[(base + place * width + k)[has]] = (values[has] >> (8 * k)) & 255
        ends = np.append(first_block, len(of)).astype(np.int32)
        body_ends = np.append(cut, len(body))[ends].astype(np.int32)
        listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
        n = len(df)
        terms = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        bodies = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(body_ends.tobytes()), pa.py_buffer(body.tobytes())])
        lists = [
            pa.array(np.full(n, shard)), terms, pa.array(df.astype(np.int64)), listed(doc[begin], pa.int32()), listed(doc[begin + count - 1], pa.int32()),
            listed(tops, pa.int64()), listed(cut - body_ends[:-1][of], pa.int32()), bodies, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())),
        ]
        table = pa.Table.from_arrays(lists, names=_NAMES)
        own = {name: pa.nulls(1, table.schema.field(name).type) for name in _NAMES} | {
            "shard": pa.array([shard]), "n": pa.array([len(self.doc_ids)]), "doc_ids": pa.array([[self.doc_ids[i] for i in by_length]], pa.list_(pa.int64())), "lengths": pa.array([length.tolist()], pa.list_(pa.int64())),
        }
        return pa.concat_tables([table, pa.table(own)])


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def build(docs: DataFrame, n_docs: int, n_terms: int, block: int = BLOCK) -> DataFrame:
    """The index of all documents, rows of INDEX; ``n_docs`` and ``n_terms`` are those of ``sizes``."""

    def index(batches) -> Iterator[pa.RecordBatch]:
        held, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                held.add(doc_id.as_py(), text.as_py() or b"")
                if held.full():
                    yield from held.rows(number, n_docs, n_terms, block).to_batches(max_chunksize=20_000)
                    held, number = _Shard(), number + 1
        if held.doc_ids:
            yield from held.rows(number, n_docs, n_terms, block).to_batches(max_chunksize=20_000)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(index, INDEX)


@dataclass
class Lists:
    """The posting lists of some terms in one shard, their blocks one after the other."""

    starts: np.ndarray
    ends: np.ndarray
    tops: np.ndarray
    cuts: np.ndarray
    counts: np.ndarray
    first: np.ndarray  # of each list its first block, and the number of all blocks
    bodies: list
    lengths: np.ndarray  # of each document
    places: np.ndarray  # of each document, in the order of doc_id

    @classmethod
    def of(cls, table: pa.Table, lengths: np.ndarray, places: np.ndarray, block: int) -> Lists:
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = table.column("n").to_numpy()
        per = -(-n // block)
        first = np.append(0, np.cumsum(per))
        counts = np.full(first[-1], block)
        counts[first[1:] - 1] = n - (per - 1) * block
        return cls(flat("starts"), flat("ends"), flat("tops"), flat("cuts"), counts, first, [x.as_py() for x in table.column("body")], lengths, places)

    def open(self, lists: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of the postings of some blocks, decompressed; ``lists`` are theirs."""
        docs, tfs = [], []
        for one, b in zip(lists.tolist(), blocks.tolist()):
            body, at, n = self.bodies[one], int(self.cuts[b]), int(self.counts[b])
            gap, tf = body[at] >> 4, body[at] & 15
            docs.append(np.cumsum(np.frombuffer(body, f"<u{gap}", n, at + 1), dtype=np.int64) + self.starts[b])
            tfs.append(np.frombuffer(body, f"<u{tf}", n, at + 1 + n * gap))
        return np.concatenate(docs), np.concatenate(tfs).astype(np.int64)

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(documents, scores) of the k best by score, then place; and how many blocks there were and were opened."""
        blocks = np.concatenate([np.arange(self.first[x], self.first[x + 1]) for x in lists])
        mine = np.repeat(lists, self.first[lists + 1] - self.first[lists])
        weight = np.repeat(weights, self.first[lists + 1] - self.first[lists])
        # The shallow moves: between two edges the same blocks lie, and their maxima bound the range.
        begin, end = self.starts[blocks], self.ends[blocks] + 1
        edges = np.unique(np.concatenate([begin, end]))
        a, b = np.searchsorted(edges, begin), np.searchsorted(edges, end)
        change = np.zeros(len(edges), dtype=np.int64)
        np.add.at(change, a, self.tops[blocks] * weight)
        np.add.at(change, b, -self.tops[blocks] * weight)
        bound, width = np.cumsum(change)[:-1], np.diff(edges)
        order = np.argsort(-bound, kind="stable")
        falling, held = -bound[order], np.cumsum(width[order])
        scores, opened = np.zeros(len(self.lengths), dtype=np.int64), np.zeros(len(blocks), dtype=bool)
        found, points, least, at, visit = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 1, 0, FIRST_VISIT
        # A range is worth a visit as long as its bound is not below the threshold.
        while at < (reach := int(np.searchsorted(falling, -least, side="right"))):
            to = min(reach, int(np.searchsorted(held, (held[at - 1] if at else 0) + visit)) + 1)
            ranges, visit = order[at:to], visit * 2
            chosen = np.zeros(len(edges) + 1, dtype=np.int64)
            chosen[ranges + 1] = 1
            chosen = np.cumsum(chosen)
            needed = np.flatnonzero((chosen[b] > chosen[a]) & ~opened)
            if len(needed):
                docs, tf = self.open(mine[needed], blocks[needed])
                np.add.at(scores, docs, np.repeat(weight[needed], self.counts[blocks[needed]]) * impacts(tf, self.lengths[docs]))
                opened[needed] = True
            spans = width[ranges]
            docs = np.arange(spans.sum()) + np.repeat(edges[ranges] - (np.cumsum(spans) - spans), spans)
            docs = docs[scores[docs] >= least]
            found, points = np.append(found, docs), np.append(points, scores[docs])
            top = np.lexsort((self.places[found], -points))[:k]
            found, points = found[top], points[top]
            least, at = max(1, int(points[-1])) if len(points) == k else 1, to
        return found, points, len(blocks), int(opened.sum())


def queries_of(items: DataFrame) -> DataFrame:
    """query (tells rows apart), item_id, terms, times of every row that has terms."""

    def split(batches):
        for batch in batches:
            held = [Counter(terms_of(x.as_py())) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), pa.array([[t.decode() for t in c] for c in held], pa.list_(pa.string())), pa.array([list(c.values()) for c in held], pa.list_(pa.int64()))],
                names=["query", "terms", "times"],
            )

    rows = materialize(items.select("item_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("query")), "items")
    split_up = rows.select("query", "text").mapInArrow(split, "query long, terms array<string>, times array<long>").filter("size(terms) > 0")
    return split_up.join(rows.select("query", "item_id").hint("merge"), "query")


def _blocks_of_queries(queries: DataFrame, most: int) -> Iterator[list]:
    held, size = [], 0
    for row in queries.select("query", "terms", "times").toLocalIterator():
        held.append((row["query"], row["terms"], row["times"]))
        size += sum(map(len, row["terms"]))
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _visitor(wanted, k: int, block: int):
    """Gives a function from a shard's rows of INDEX to query, doc_id, score of its k best for every query of the broadcast ``wanted``."""

    def visit(shard: pa.Table) -> pa.Table:
        own, table = shard.filter(pc.is_null(shard.column("term"))), shard.filter(pc.is_valid(shard.column("term")))
        doc_ids = own.column("doc_ids")[0].as_py()
        order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0))
        places = np.empty(len(order), dtype=np.int64)
        places[order] = np.arange(len(order))
        at, rows = {t: i for i, t in enumerate(table.column("term").to_pylist())}, []
        lists = Lists.of(table, own.column("lengths")[0].values.to_numpy(), places, block) if at else None
        for query, terms in wanted.value:
            here = [(at[t], w) for t, w in terms if t in at]
            if here:
                docs, scores, _, _ = lists.best(np.array([x for x, _ in here]), np.array([w for _, w in here], dtype=np.int64), k)
                rows += [(query, doc_ids[d], s) for d, s in zip(docs.tolist(), scores.tolist())]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "doc_id", "score"), columns)})

    return visit


def search(index: DataFrame, queries: DataFrame, n_docs: int, k: int = 10, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query, rank, doc_id, score: the k documents of the whole index that score highest for each query, all above 0."""
    spark, out = index.sparkSession, None
    for part in _blocks_of_queries(queries, query_bytes):
        asked = spark.createDataFrame([(t,) for t in sorted({t for _, terms, _ in part for t in terms})], "term string")
        hits = index.join(F.broadcast(asked), "term")
        frequencies = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in frequencies.items()}
        wanted = spark.sparkContext.broadcast([(q, [(t, weight[t] * n) for t, n in zip(terms, times) if weight.get(t, 0) > 0]) for q, terms, times in part])

        shards = hits.select(*_NAMES).unionByName(index.filter("term is null"))
        found = shards.groupBy("shard").applyInArrow(_visitor(wanted, k, block), "query long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query long, rank int, doc_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    n_docs, n_terms = sizes(docs)
    index = materialize(build(docs, n_docs, n_terms), "index")
    queries = materialize(queries_of(items), "queries")
    found = materialize(search(index, queries, n_docs, k), "found")
    discard(index)
    return found.join(F.broadcast(queries.select("query", "item_id")) if queries.count() <= QUERY_BYTES // 64 else queries.select("query", "item_id").hint("merge"), "query").select(
        "item_id", "rank", "doc_id", "score"
    )


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    return r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
q as (select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
qt as materialized (select q, term, count(*) as times from (select q, unnest(ws) as term from q) group by all),
z as (select count(*) as n_docs, cast(sum(len(ws)) as bigint) as n_terms from d where len(ws) > 0),
tf as materialized (select r, term, count(*) as tf from (select r, unnest(ws) as term from d) where term in (select term from qt) group by all),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from tf group by term), z),
m as (select r, doc_id, 25 + (75 * len(ws) * n_docs) // n_terms as m from d, z where len(ws) > 0),
s as (select q, r, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score from qt join w using (term) join tf using (term) join m using (r) group by all),
k as (select q, doc_id, score, cast(row_number() over (partition by q order by score desc, doc_id nulls last) as int) as rank from s join m using (r) where score > 0)
select item_id, rank, doc_id, score from k join q using (q) where rank <= 10
"""
