"""Exact Jaccard join of documents on word shingles, by pivots in a metric space.

Jaccard distance is a metric, and two documents link when it is at most r = 1 - threshold.

1. Element pivots. A single shingle is a pivot at distance 1 - 1/n of every document that
   holds it and at distance 1 of all others, so a document is equally near to all its own
   shingles. Ties are broken by rarity: its region is that of its rarest shingle, and it is
   replicated into the regions of its next rarest ones as long as a linked document could
   differ in all before (n - ceil(threshold * n) + 1 of them). Linked documents then meet in
   a region. Whole documents would not do as pivots here: nearly all distances to them are
   exactly 1. Rarity is counted over all documents on a fixed third of the hash space,
   which is enough to rank; the few documents with too few shingles there fill up by hash.
   That leaves short documents that share a common line in its regions. So the documents in
   regions, a small part of all, are ranked once more by all their shingles, counted among
   themselves: whoever has enough shingles of its own drops out, and cells do not grow with
   the number of documents that hold a common passage.
2. Regions that share documents form cells. A cell too large for one task is split around
   document pivots of its own. Each document goes to the Voronoi region of the nearest pivot
   if that is within ``NEAR``, and is replicated into region j when the triangle inequality
   lets it have a link there: its distance to pivot j is at most that of the farthest
   document of the region plus r, and at most its own nearest distance plus 2 r. Documents
   near no pivot are left; if they still are too many for one task, they are joined region
   by region of their shingles (step 1), so a cell that chance has strung together costs no
   more than its regions. Documents within r of a pivot are linked through it.
3. A region too large for one task is joined in blocks of bounded size, only for pairs with a
   document outside its largest linked part. Inside a block the join goes on recursively by
   pivots: the distances of one document to all others decide all its pairs, documents
   already linked are skipped, and a pair is skipped when its distances to some earlier
   pivot differ by more than r, or when the shingles that each has in common with any
   document of the block are too few for a link.

Shingles are 64-bit hashes; candidates are compared by their full sets of these, sets are
told apart by 128 bits.

Scale: one shuffle of a third of the shingles as (hash, document), which is counted with
map-side partial aggregation and joined back, and one of all shingles of the documents that
then stand in regions; hashes, sets and nodes that hold more than a thousandth of the rows
are joined by broadcast, so none ends in one task. The text is shuffled once, for the
documents that share rare shingles, by a merge join at every size.
Equal sets are joined once. Pivot texts are broadcast only when their bytes are few.

Defined results: null, empty and blank text has 0 shingles and is its own component; fewer
than ``size`` words make one shingle of all of them; rows that repeat a doc_id are one node
of the link graph, with the links of all their texts; a null doc_id takes part only as a
copy of others; an empty table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.operators.components import connected_components
from stratafold.operators.skew import heavy_join
from stratafold.scratch import discard, materialize

#: Share of the hash space in which rarity is counted.
SAMPLE = 0.35
#: Shingles that one task may join.
BLOCK_SHINGLES = 1_500_000
#: Document pivots of a large cell, and bytes of their texts up to which they are broadcast.
PIVOTS, PIVOT_BYTES = 8, 8 << 20
#: Large cells up to whose number tables of one short row each are broadcast.
FEW_CELLS = 20_000
#: Documents farther than this from all pivots belong to no pivot's region; pivots this near each other count once.
NEAR, APART = 0.5, 0.8

_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (a multiply-xorshift finaliser)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def shingle_set(text: str | bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    global _POWERS
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    b = np.frombuffer(raw.translate(_LOWER), np.uint8)
    word = ~_BLANK[b]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    if (longest := int((ends - starts).max())) > len(_POWERS):
        _POWERS = _powers(2 * longest)
    lengths = ends - starts
    inside = b[word].astype(np.uint64) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    hashes = _mix(np.add.reduceat(inside * _POWERS[place], first))
    n = len(hashes) - size + 1
    if n < 1:
        hashes, n, size = np.append(hashes, np.uint64(len(hashes))), 1, len(hashes) + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * np.uint64(((k + 1) * _BASE | 1) & _MASK)
    return np.unique(_mix(total))


def quota(n: int, percent: int) -> int:
    """How many of a document's rarest shingles hold one of every linked document."""
    return n - (percent * n + 99) // 100 + 1


def pivot_shingles(shingles: np.ndarray, percent: int, sample: float = SAMPLE) -> np.ndarray:
    """The shingles in the counted part of the hash space, and further ones up to the quota."""
    if sample >= 1:
        return shingles
    n = int(np.searchsorted(shingles, np.uint64(int(sample * 2.0**64))))
    return shingles[: max(n, quota(len(shingles), percent))]


def _over_texts(df: DataFrame, f, schema: str, names: list[str], types: list) -> DataFrame:
    """Applies f(id, text bytes) -> row to (doc_id, text), in batches of bounded size."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                row = f(doc.as_py(), text.as_py())
                held.append(row)
                size += 64 + sum(x.nbytes for x in row if isinstance(x, np.ndarray))
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "utf-8").alias("text")).mapInArrow(run, schema)


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    one, two = _mix(shingles ^ np.uint64(_BASE)).sum(dtype=np.uint64), _mix(shingles + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def profiles(docs: DataFrame, size: int, percent: int, sample: float = SAMPLE) -> DataFrame:
    """doc_id, n, a 128-bit signature of the set, and the pivot shingles hs, in one pass over the texts."""

    def row(doc, text):
        s = shingle_set(text, size)
        return doc, len(s), *signature(s), pivot_shingles(s, percent, sample).view(np.int64)

    names = ["doc_id", "n", "s1", "s2", "hs"]
    return _over_texts(docs, row, "doc_id long, n long, s1 long, s2 long, hs array<long>", names, [pa.int64()] * 4 + [pa.list_(pa.int64())])


def rare_regions(raw: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """(h, doc_id, s1, first): the regions that at least two different sets enter; own: doc_id, s1, n, m of the sets to be joined."""
    rows = raw.select(F.explode("hs").alias("h"), "doc_id", "s1")
    counts = materialize(rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").withColumn("held", F.col("df")), "counts")
    total = raw.agg(F.sum(F.size("hs"))).first()[0] or 0
    shared = materialize(heavy_join(rows, counts, ["h"], "held", total), "shared")
    held = shared.join(own.hint("merge"), ["doc_id", "s1"])
    by_doc = W.partitionBy("doc_id", "s1")
    need = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    free = need - (F.col("m") - F.count("*").over(by_doc))
    ranked = held.withColumn("free", free).filter("free > 0").withColumn("place", F.row_number().over(by_doc.orderBy("df", "h")))
    near = materialize(ranked.filter("place <= free").select("h", "doc_id", "s1").distinct(), "regions")
    ends = near.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("held")).filter("first < last").drop("last")
    regions = materialize(heavy_join(near, ends, ["h"], "held", near.count()), "regions")
    discard(counts, shared, near)
    return regions


class _Forest:
    def __init__(self, n: int):
        self.label = np.arange(n)
        self.size = np.ones(n, np.int64)

    def merge(self, a: int, b: int) -> bool:
        a, b = self.label[a], self.label[b]
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.label[self.label == b] = a
        self.size[a] += self.size[b]
        return True


def block_links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, seed: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (indexes) that join all documents that the full link graph of the block joins.

    ``side``: only pairs of different sides are compared. ``seed``: labels of documents
    that are known to be connected.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    forest, links = _Forest(count), []
    if seed is not None:
        first: dict[int, int] = {}
        for i, x in enumerate(seed.tolist()):
            forest.merge(first.setdefault(x, i), i)
    values, owner = np.concatenate(sets), np.repeat(np.arange(count), sizes)
    order = np.argsort(values, kind="stable")
    owner_by_value = owner[order]
    ordered = values[order]
    new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    group = np.empty(len(values), np.int64)
    group[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(ordered))))
    bounds = np.append(new, len(ordered))
    # How many shingles of each document some other document of the block holds.
    common_at_most = np.bincount(owner, weights=(np.diff(bounds) > 1)[group], minlength=count)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    used = np.zeros(count, bool)
    distances: list[np.ndarray] = []
    radius = 1 - percent / 100 + 1e-9

    def compare(x: int) -> None:
        may = ~used & (forest.label != forest.label[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
        may &= (100 + percent) * np.minimum(common_at_most, common_at_most[x]) >= percent * (sizes + sizes[x])
        if side is not None:
            may &= side != side[x]
        for d in distances:
            may &= np.abs(d - d[x]) <= radius
        used[x] = True
        if not may.any():
            return
        g = group[offsets[x] : offsets[x + 1]]
        lo, n = bounds[g], bounds[g + 1] - bounds[g]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner_by_value[at], minlength=count)
        union = sizes + sizes[x] - common
        if len(distances) < 8:
            distances.append(1 - common / union)
        for y in np.flatnonzero(may & (100 * common >= percent * union)):
            if forest.merge(x, int(y)):
                links.append((x, int(y)))

    # Once every document outside the largest component has been a pivot, all pairs are decided.
    rest, known = iter(()), -1
    while True:
        if known != len(links):
            largest, known = np.argmax(np.bincount(forest.label, minlength=count)), len(links)
            rest = iter(np.flatnonzero(~used & (forest.label != largest)).tolist())
        if (x := next(rest, None)) is None:
            break
        compare(x)
    return links


def _by_cell(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Joins a table of one short row per large cell: by broadcast where the cells are counted to be few, so that a cell stays spread."""
    few = table.count() <= FEW_CELLS
    return rows.join(F.broadcast(table) if few else table.hint("merge"), "cell", how)


def weighed(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows (cell, n, ...) of cells that fit one task, and of those that do not."""
    weights = rows.groupBy("cell").agg(F.sum("n").alias("weight"))
    large = materialize(weights.filter(F.col("weight") > block).select("cell"), "heavy")
    return _by_cell(rows, large, "left_anti"), _by_cell(rows, large, "left_semi")


def whole(rows: DataFrame) -> DataFrame:
    """Cells as groups of one task each."""
    return rows.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "seed", "doc_id", "s1", "text")


def blocks_of(rows: DataFrame, block: int) -> DataFrame:
    """Large cells as groups (cell, i, j) of bounded size, in which every pair with a document outside the largest linked part meets."""
    sizes = rows.groupBy("cell", "seed").agg(F.count("*").alias("c"))
    core = sizes.groupBy("cell").agg(F.max(F.struct("c", "seed")).alias("m")).select("cell", F.col("m.seed").alias("core"))
    rows = _by_cell(rows, core).withColumn("side", F.when(F.col("seed") == F.col("core"), 0).otherwise(1))
    shares = rows.groupBy("cell", "side").agg(F.ceil(2 * F.sum("n") / F.lit(block)).cast("int").alias("blocks"))
    shares = shares.groupBy("cell").pivot("side", [0, 1]).agg(F.first("blocks")).select(
        "cell", F.coalesce("0", F.lit(0)).alias("nb0"), F.coalesce("1", F.lit(0)).alias("nb1")
    )
    rows = _by_cell(rows, shares)
    at = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.when(F.col("side") == 0, F.col("nb0")).otherwise(F.col("nb1"))).cast("int")
    rows = rows.withColumn("at", at).filter("nb1 > 0")
    # Core blocks meet every outer block; outer blocks meet each other and themselves.
    inner = rows.filter("side = 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb1") - 1))).select(
        "cell", (-1 - F.col("at")).alias("i"), "j", F.lit(0).alias("side"), "seed", "doc_id", "s1", "text"
    )
    outer = rows.filter("side = 1 and nb0 > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("nb0")))).select(
        "cell", (-F.col("i")).alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"), "seed", "doc_id", "s1", "text"
    )
    pairs = rows.filter("side = 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nb1") - 1))).select(
        "cell", F.least("at", "k").alias("i"), F.greatest("at", "k").alias("j"),
        F.when(F.col("at") == F.col("k"), -1).when(F.col("at") < F.col("k"), 0).otherwise(1).alias("side"), "seed", "doc_id", "s1", "text"
    )
    return inner.union(outer).union(pairs)


def voronoi(near: DataFrame, percent: int) -> DataFrame:
    """(cell, doc_id, s1, pivot): the regions of every document, its own and those it is replicated into; pivot is null for none.

    near: cell, doc_id, s1, pivot, d, the distances of all documents to the pivots of their cell.
    """
    radius = 1 - percent / 100 + 1e-9
    # Of pivots close to each other the one with the smallest doc_id counts.
    twins = near.filter((F.col("d") <= APART) & (F.col("pivot") < F.col("doc_id"))).select("cell", F.col("doc_id").alias("pivot")).distinct()
    apart = near.join(twins.hint("merge"), ["cell", "pivot"], "left_anti")
    # The nearest pivot, with the pivots' distances beside it: as many as a cell has pivots.
    home = near.select("cell", "doc_id", "s1").distinct().join(
        apart.groupBy("cell", "doc_id", "s1").agg(F.min(F.struct("d", "pivot")).alias("own"), F.collect_list(F.struct("pivot", "d")).alias("all")).hint("merge"),
        ["cell", "doc_id", "s1"], "left",
    )
    home = home.withColumn("own", F.when(F.col("own.d") <= NEAR, F.col("own")))
    cover = home.filter("own is not null").groupBy("cell", F.col("own.pivot").alias("pivot")).agg(F.max("own.d").alias("cover"))
    cover = cover.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("pivot", "cover"))).alias("covers"))
    home = home.join(cover.hint("merge"), "cell", "left")
    reached = F.filter("all", lambda x: (x["pivot"] == F.col("own.pivot")) | (
        (x["d"] <= F.try_element_at("covers", x["pivot"]) + radius) & (F.col("own").isNull() | (x["d"] <= F.col("own.d") + 2 * radius))
    ))
    pivots = F.transform(F.filter(reached, lambda x: x.isNotNull()), lambda x: x["pivot"])
    none = F.when(F.col("own").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>"))
    return home.select("cell", "doc_id", "s1", F.explode(F.concat(F.coalesce(pivots, F.array().cast("array<long>")), none)).alias("pivot"))


def cell_links(members: DataFrame, regions: DataFrame, docs: DataFrame, size: int, percent: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b) links that connect what is connected in each cell; members: doc_id, s1, cell, n."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if _repeats(docs):
        texts = texts.groupBy("doc_id", F.xxhash64("text").alias("tie")).agg(F.first("text").alias("text")).drop("tie")
    # Where a doc_id has several texts, each set meets all of them here; the join drops those that are not its own.
    rows = materialize(texts.join(members.hint("merge"), "doc_id"), "cells")
    small, large = weighed(rows, block)
    groups, balls = whole(small.withColumn("seed", F.col("doc_id"))), None
    if not large.isEmpty():
        large = materialize(large, "large")
        near = materialize(distances(large, size, percent), "near")
        balls = near.filter(F.col("d") <= 1 - percent / 100 + 1e-9).filter("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
        parts = connected_components(balls)
        large = large.join(parts.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn("seed", F.coalesce("component", "doc_id")).drop("component")
        placed = materialize(voronoi(near, percent), "voronoi")
        key = ["cell", "doc_id", "s1"]
        inside = large.join(placed.filter("pivot is not null").hint("merge"), key).withColumn("cell", F.xxhash64("cell", "pivot")).drop("pivot")
        left_small, left_large = weighed(large.join(placed.filter("pivot is null").drop("pivot").hint("merge"), key), block)
        strung = left_large.drop("cell").join(regions.select(F.col("h").alias("cell"), "doc_id", "s1").hint("merge"), ["doc_id", "s1"])
        columns = ["cell", "doc_id", "s1", "n", "seed", "text"]
        split = inside.select(columns).union(left_small.select(columns)).union(strung.select(columns))
        fit, over = weighed(materialize(split, "split"), block)
        groups = groups.union(whole(fit)).union(blocks_of(over, block))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "s1"], kind="stable")
        kept, sets, met = [], [], set()
        for i, (doc, s1, text) in enumerate(zip(pdf["doc_id"], pdf["s1"], pdf["text"])):
            if (doc, s1) not in met and signature(found := shingle_set(text, size))[0] == s1:
                met.add((doc, s1))
                kept.append(i)
                sets.append(found)
        if len(sets) < 2:
            return pd.DataFrame([], columns=["a", "b"])
        pdf = pdf.iloc[kept]
        side, ids = pdf["side"].to_numpy(), pdf["doc_id"].to_numpy()
        split = len(set(side.tolist())) > 1
        found = block_links(sets, percent, side if split else None, pdf["seed"].to_numpy())
        return pd.DataFrame([(ids[a], ids[b]) for a, b in found], columns=["a", "b"])

    links = groups.groupBy("cell", "i", "j").applyInPandas(join, "a long, b long")
    return links if balls is None else links.union(balls)


def _repeats(docs: DataFrame) -> bool:
    """Whether some doc_id stands in more than one row."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 and doc_id is not null").isEmpty()


def distances(large: DataFrame, size: int, percent: int) -> DataFrame:
    """cell, doc_id, s1, pivot, d: the distances of the documents to up to PIVOTS documents of their cell, picked by hash."""
    key = F.struct(F.xxhash64("doc_id", "s1").alias("x"), "doc_id", "s1", "text")
    tops = large.groupBy("cell", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PIVOTS)).alias("k")).agg(F.min(key).alias("m"))
    pivots = materialize(tops.select("cell", F.col("m.doc_id").alias("pivot"), F.col("m.s1").alias("pivot_s1"), F.col("m.text").alias("pivot_text")), "pivots")
    bytes_ = pivots.agg(F.sum(F.octet_length("pivot_text"))).first()[0] or 0
    pairs = large.select("cell", "doc_id", "s1", "text").join(F.broadcast(pivots) if bytes_ <= PIVOT_BYTES else pivots.hint("merge"), "cell")

    def run(batches):
        sets: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            out, last, own = [], None, None
            for cell, doc, s1, text, pivot, pivot_s1, pivot_text in pdf[["cell", "doc_id", "s1", "text", "pivot", "pivot_s1", "pivot_text"]].itertuples(index=False):
                if (doc, s1, text) != last:
                    last, own = (doc, s1, text), shingle_set(text, size)
                    own = own if signature(own)[0] == s1 else None
                if own is None:
                    continue
                if (pivot, pivot_s1) not in sets:
                    if len(sets) > 64:
                        sets.clear()
                    sets[pivot, pivot_s1] = shingle_set(pivot_text, size)
                theirs = sets[pivot, pivot_s1]
                common = len(np.intersect1d(own, theirs, assume_unique=True))
                out.append((cell, doc, s1, pivot, 1 - common / (len(own) + len(theirs) - common)))
            yield pd.DataFrame(out, columns=["cell", "doc_id", "s1", "pivot", "d"])

    return pairs.mapInPandas(run, "cell long, doc_id long, s1 long, pivot long, d double")


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select("doc_id", "text")
    raw = materialize(profiles(docs, size, percent), "profiles")
    some = raw.filter("n > 0").select("doc_id", "n", "s1", "s2", F.size("hs").alias("m"))
    reps = materialize(some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("held")), "reps")
    profile = heavy_join(some, reps, ["s1", "s2", "n"], "held", raw.count()).select("doc_id", "n", "s1", "m", "rep")
    none = raw.filter("n = 0").select("doc_id", "n", "s1", F.lit(0).alias("m"), F.col("doc_id").alias("rep"))
    profile = materialize(profile.union(none), "profiles")
    own = profile.filter("doc_id = rep and n > 0").select("doc_id", "s1", "n", "m").distinct()
    rough = rare_regions(raw, own, percent)
    discard(raw, reps)
    own = materialize(own.drop("m").join(rough.select("doc_id", "s1").distinct().hint("merge"), ["doc_id", "s1"]), "chosen")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(own.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    docs = materialize(docs, "texts")
    discard(rough)
    full = materialize(profiles(docs, size, percent, 1.0), "sets")
    regions = rare_regions(full, own.withColumn("m", F.col("n")), percent)
    discard(full)
    cells = connected_components(regions.filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct())
    members = materialize(
        cells.select(F.col("node").alias("doc_id"), F.col("component").alias("cell")).join(own.hint("merge"), "doc_id"), "members"
    )
    links = materialize(cell_links(members, regions, docs, size, percent), "links")
    discard(regions, members, own, docs)
    # All sets of one doc_id belong together.
    several = profile.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).filter("b < hi").drop("hi")
    same = profile.select("doc_id", F.col("rep").alias("a")).join(several.hint("merge"), "doc_id").select("a", "b")
    found = materialize(connected_components(links.select("a", "b").union(same)), "components")
    discard(links)
    nodes = profile.filter("rep is not null").groupBy("rep").agg(F.count("*").alias("held"))
    nodes = nodes.join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    nodes = materialize(nodes, "components")
    named = heavy_join(profile, nodes, ["rep"], "held", profile.count()).select("doc_id", "n", "component")
    lost = profile.filter("rep is null").select("doc_id", "n", F.col("rep").alias("component"))
    return named.union(lost).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
