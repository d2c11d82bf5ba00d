"""Mixing sources to target weights.

The tokens of a source are packed into fixed-length blocks, one stream per source, so that
only its last block is short. A source fills slots until their tokens are its target: whole
passes over its blocks as often as its size goes into the target, then blocks until the rest
is reached, the last of them in part. Each slot draws its output shard from all shards
alike, so the counts of a source over the shards are a multinomial draw whose total is held:
without that a source would miss its target, and one at its cap would exceed it. The number
of a slot within its pass goes through a keyed permutation of the source's full blocks (a
four-round Feistel walk), the short block comes last, and blocks join by index. ``mixed``
gives the tokens of every slot of every shard; ``mix`` counts per document what the same
join takes. DataFrame functions only.

Scale: sizes are counted once and written without the text; rows that are alike are one row
with a count until they are cut. Documents are packed within chunks of a few thousand
documents of one source, so neither a hot source nor a hot or missing doc_id is ordered in
one task; sources and chunks are numbered range by range, and a block may begin in one chunk
and end in the next. The table of sources is broadcast only when it is counted to be small,
else the joins with it are salted; all sides that grow with the documents are merge-joined.
``mixed`` shuffles the texts, ``mix`` does not.

Defined results: null text has size 0 and is taken 0 times; a null source is a source of
its own and ranks last; repeated rows are rows of their own; an empty table gives no rows.
Columns beside doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.llm.text import BLANK, n_blank_words
from stratafold.operators.ordering import with_running
from stratafold.scratch import materialize

SALTS = 64
#: Sources, and bytes of their names, up to which the table of sources is broadcast.
FEW_SOURCES, FEW_BYTES = 100_000, 8 << 20
#: Slots that one task makes: the chunks they are made from are a far smaller table, of few tasks.
SLOTS_A_TASK = 50_000
#: Copies of a row that one chunk packs together.
COPIES = 64
ROUNDS = 4
#: Steps of a walk. Fewer than one step in sqrt(n) leaves the n indexes, so none needs as many.
WALK = 24


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, a non-null key of the source, and a hash of the text."""
    return docs.select(
        "doc_id", "source", n_blank_words(F.col("text")).alias("size"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), F.xxhash64("text").alias("tie"),
    )


def source_targets(sizes: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """skey, n_docs, source_size, target: weights by rank of the source, no target above cap * size.

    Water filling in closed form: with the sources in order of cap * size / weight, the
    first at which the level of what is left reaches no cap fixes the level of all others.
    """
    per = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = with_running(per, [F.col("source").asc_nulls_last()]).withColumnRenamed("place", "rank")
    per = per.withColumn("w", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("w"))
    filled = with_running(per, ["ratio", "rank"], {"most_before": "most", "w_before": "w"})
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w"), F.max("ratio").alias("ratio")).first()
    level = (F.lit(whole["size"] or 0) - F.col("most_before")) / (F.lit(whole["w"] or 1.0) - F.col("w_before"))
    first = filled.withColumn("level", level).filter("level <= ratio").agg(F.min(F.struct("place", "level")).alias("m")).first()["m"]
    fixed = F.lit(first["level"] if first else whole["ratio"] or 0.0)
    return filled.select("skey", "n_docs", "source_size", F.least(fixed * F.col("w"), F.col("most")).alias("target"))


def with_source(rows: DataFrame, sources: DataFrame, few: bool, salt_by: list[str]) -> DataFrame:
    """``rows`` with the columns of their source; a hot source is spread over tasks where the table is not small."""
    if few:
        return rows.join(F.broadcast(sources), "skey")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int"))
    return rows.join(salted.hint("merge"), ["skey", "salt"]).drop("salt")


def permuted(j: Column, n: Column, key: list[Column]) -> Column:
    """The place of index j under a keyed permutation of 0 .. n - 1: a Feistel walk on a grid just larger than n."""
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.ceil(n / a).cast("long")

    def step(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
        for r in range(ROUNDS):
            if r % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(*key, F.lit(r), left), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(*key, F.lit(r), right), a), a)
        return left * b + right

    at = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(j), lambda x, _: F.when(x < n, x).otherwise(step(x)))
    return F.when(at < n, at).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


class Plan:
    """Which tokens of which document fill which slot of which shard."""

    def __init__(self, docs: DataFrame, weights, cap: float, block_tokens: int, shard_slots: int, chunk_docs: int, seed: int):
        self.docs, self.block_tokens, self.seed = docs, block_tokens, seed
        sizes = materialize(sized(docs), "sizes")
        targets = materialize(source_targets(sizes, weights, cap), "targets")
        n, width = targets.agg(F.count("*"), F.sum(F.octet_length("skey"))).first()
        self.few = n <= FEW_SOURCES and (width or 0) <= FEW_BYTES
        alike = sizes.groupBy("doc_id", "source", "skey", "size", "tie").agg(F.count("*").alias("rows"))
        alike = alike.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {COPIES}"))))
        alike = alike.withColumn("copies", F.least(F.col("rows") - F.col("lot") * COPIES, F.lit(COPIES))).drop("rows")
        rows = with_source(alike, targets, self.few, ["doc_id", "tie", "lot"])
        self.rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie", "size", "lot", F.lit(17)), F.ceil(F.col("n_docs") / F.lit(chunk_docs))))
        chunks = self.rows.groupBy("skey", "chunk").agg(F.sum(F.col("size") * F.col("copies")).alias("in_chunk"))
        chunks = with_running(chunks, ["skey", "chunk"], {"before": "in_chunk"}).drop("place")
        self.chunks = materialize(chunks, "chunks")
        # Of each source: where its stream starts, its blocks, the full ones, whole passes and the tokens of the last one.
        size, tokens = F.col("source_size"), F.floor(F.col("target") + F.lit(1e-6)).cast("long")
        sources = self.chunks.groupBy("skey").agg(F.min("before").alias("start")).join(targets, "skey").filter("source_size > 0")
        self.sources = sources.select(
            "skey", "start", "source_size", F.expr(f"(source_size + {block_tokens - 1}) div {block_tokens}").alias("n"), F.expr(f"source_size div {block_tokens}").alias("full"),
            F.floor(tokens / size).cast("long").alias("passes"), F.pmod(tokens, size).alias("rest"),
        )
        slots = int(self.sources.agg(F.sum(F.col("n") * F.col("passes") + F.ceil(F.col("rest") / F.lit(block_tokens)))).first()[0] or 0)
        self.shards, self.slot_tasks = max(1, -(-slots // shard_slots)), max(1, -(-slots // SLOTS_A_TASK))

    def slots(self) -> DataFrame:
        """One row per slot: source and block, number k within the source, shard, and how many tokens of the block it takes."""
        rows = with_source(self.chunks.filter("in_chunk > 0"), self.sources, self.few, ["chunk"]).repartition(self.slot_tasks, "skey", "chunk")
        size, low = F.lit(self.block_tokens).cast("long"), F.col("before") - F.col("start")
        # The blocks that begin in the chunk, each of them the number of a slot in every pass.
        first, last = F.ceil(low / size).cast("long"), F.ceil((low + F.col("in_chunk")) / size).cast("long") - 1
        rows = rows.withColumn("j", F.explode(F.when(last >= first, F.sequence(first, F.greatest(first, last)))))
        length = F.when(F.col("j") < F.col("full"), size).otherwise(F.col("source_size") - F.col("full") * size)
        over = F.greatest(F.least(F.col("rest") - F.col("j") * size, length), F.lit(0))
        takes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda p: F.struct(p.alias("pass"), F.when(p < F.col("passes"), length).otherwise(over).alias("take")))
        rows = rows.withColumn("t", F.explode(F.filter(takes, lambda t: t["take"] > 0))).withColumn("k", F.col("t.pass") * F.col("n") + F.col("j"))
        key = [F.lit(self.seed), F.col("skey")]
        block = F.when(F.col("j") < F.col("full"), permuted(F.col("j"), F.greatest(F.col("full"), F.lit(1)), key)).otherwise(F.col("full"))
        return rows.select("skey", block.alias("block"), "k", F.pmod(F.xxhash64(*key, F.col("k")), F.lit(self.shards)).alias("shard"), F.col("t.take").alias("take"))

    def pieces(self) -> DataFrame:
        """The documents' tokens cut at block ends, joined to the slots by source and block index.

        One row per piece and slot: ``n`` tokens from place ``lo`` of the document stand at
        ``at`` in the slot's block. A piece without a slot, and a document without tokens,
        has one row without shard and n = 0.
        """
        inside = W.partitionBy("skey", "chunk").orderBy("doc_id", "size", "tie", "lot")
        before = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rows = self.rows.withColumn("rn", F.row_number().over(inside)).withColumn("off", before)
        starts = self.chunks.groupBy("skey").agg(F.min("before").alias("start"))
        rows = rows.join(self.chunks.select("skey", "chunk", "before").hint("merge"), ["skey", "chunk"])
        rows = with_source(rows, starts, self.few, ["chunk", "rn"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        rows = rows.withColumn("off", F.col("before") - F.col("start") + F.col("off") + F.col("copy") * F.col("size"))
        size = F.lit(self.block_tokens).cast("long")

        def piece(block):
            lo = F.greatest(F.col("off"), block * size)
            return F.struct(
                block.alias("block"), (lo - block * size).alias("at"), (lo - F.col("off")).alias("lo"), (F.least(F.col("off") + F.col("size"), (block + 1) * size) - lo).alias("n"),
            )

        blocks = F.sequence(F.expr(f"off div {self.block_tokens}"), F.expr(f"(off + size - 1) div {self.block_tokens}"))
        rows = rows.withColumn("piece", F.explode_outer(F.when(F.col("size") > 0, F.transform(blocks, piece))))
        rows = rows.select("skey", "source", "chunk", "rn", "copy", "doc_id", "tie", "size", "source_size", "target", "piece.*")
        # Slots are many times more than their estimate: they must not be broadcast.
        out = rows.join(self.slots().hint("merge"), ["skey", "block"], "left")
        n = F.greatest(F.least(F.col("take") - F.col("at"), F.col("n")), F.lit(0))
        return out.withColumn("n", F.when(F.col("take").isNotNull(), n).otherwise(0).cast("long"))


def mixed(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0, block_tokens: int = 128, shard_slots: int = 8192, chunk_docs: int = 2048, seed: int = 7) -> DataFrame:
    """shard, source, slot (its number within the source), block, n_tokens, tokens (parted by spaces) of the mix."""
    plan = Plan(docs, weights, cap, block_tokens, shard_slots, chunk_docs, seed)
    row = ["doc_id", "skey", "tie"]
    took = plan.pieces().filter("n > 0").groupBy(*row, "chunk", "rn", "copy", "source").agg(F.collect_list(F.struct("shard", "k", "block", "at", "lo", "n")).alias("parts"))
    texts = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), F.xxhash64("text").alias("tie"), "text")
    # Rows that agree in all three hold the same text: one of them serves all.
    texts = texts.groupBy(*row).agg(F.first("text").alias("text"))
    same = took["doc_id"].eqNullSafe(texts["doc_id"]) & (took["skey"] == texts["skey"]) & (took["tie"] == texts["tie"])
    rows = took.join(texts.hint("merge"), same).select("source", took["skey"], "parts", F.array_remove(F.split("text", BLANK), "").alias("words"))
    cut = F.transform("parts", lambda p: F.struct(
        p["shard"].alias("shard"), p["k"].alias("slot"), p["block"].alias("block"), p["at"].alias("at"), p["n"].alias("n"),
        F.array_join(F.slice("words", (p["lo"] + 1).cast("int"), p["n"].cast("int")), " ").alias("tokens"),
    ))
    rows = rows.select("source", "skey", F.explode(F.when(F.size("words") > 0, cut)).alias("p")).select("source", "skey", "p.*")
    slots = rows.groupBy("shard", "skey", "slot", "block").agg(
        F.first("source").alias("source"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("parts")
    )
    return slots.select("shard", "source", "slot", "block", "n_tokens", F.array_join("parts.tokens", " ").alias("tokens"))


def mix(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0, block_tokens: int = 128, shard_slots: int = 8192, chunk_docs: int = 2048, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of each document, repeats counted)."""
    pieces = Plan(docs, weights, cap, block_tokens, shard_slots, chunk_docs, seed).pieces()
    return pieces.groupBy("skey", "chunk", "rn", "copy", "doc_id", "size", "source_size", "target").agg(F.sum("n").alias("taken")).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken"
    )
