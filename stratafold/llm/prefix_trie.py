"""Conversation prefix trie: every prefix that conversations share is one node.

A conversation becomes an array of turn keys (128 bits of the SHA-256 of role and text) with
the number of words of each turn. The arrays are sorted globally, by range, equal ones by
conv_id. Within a range one sweep keeps the open prefixes of the last conversation on a
stack: the next conversation shares with it as many turns as their longest common prefix
(LCP); the deeper nodes on the stack are closed and passed on, and nodes for the turns beyond
the LCP are opened. A closed node is complete unless it is a prefix of the first or of the
last conversation of its range: those may go on in the ranges beside it. Their partial
counts, one row per open node, are stitched by the same sweep over the stacks of all ranges
in order: nodes of neighbouring stacks that agree are one node.

Scale: turns are shuffled once, without their texts; arrays once. A conversation is one row,
so its turns must fit in memory (24 bytes each); conversations that start alike, or are
equal, are spread over ranges, since conv_id is part of the order. The stitch is one task
over at most twice the longest conversation's nodes per range, read as a stream: its size
follows the number of ranges, not the conversations. Conversations that end in one node are
hashed as they pass; runs too long for a buffer, or cut by a range's end, leave as chunks of
decimal ids. Such chunks are hashed in order as a stream, since SHA-256 has to see its bytes
in order: what one task reads of a node is the ids, some ten bytes a conversation. Nodes get
their parent's name by a join in which parents of many children are broadcast (``skew``).

Defined results: turns are ordered by turn, null first; equal turns of one conversation by
their keys; null role or text is empty; rows without conv_id belong to no conversation;
an empty table gives no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.text import n_blank_words
from stratafold.operators.skew import heavy_join
from stratafold.scratch import discard, materialize

#: Ids of conversations that a run holds before they leave as a chunk.
CHUNK_IDS = 4096
KEY_BYTES = 16

#: What a sweep gives. kind: node (complete), left or right (open at a range's start or end, the node's own
#: part without that of other open nodes), ids (decimal ids of conversations that end in a node).
SWEPT = (
    "part int, kind string, seq long, node binary, parent binary, depth long, words long, conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved long, ends_sha256 string, ids string"
)
_FIELDS = pa.schema(
    [pa.field(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in SWEPT.split(", "))]
)
ROOT = hashlib.sha256(b"root").digest()[:KEY_BYTES]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_arrays(convs: DataFrame) -> DataFrame:
    """conv_id, turns (array of key, words) of every conversation, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY_BYTES))
    rows = convs.filter("conv_id is not null").select("conv_id", F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"), key.alias("key"), n_blank_words(text).alias("words"))
    turns = F.array_sort(F.collect_list(F.struct("has", "turn", "key", "words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns")
    )


def rebuilt(arrays: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """The conversations with their first h turns taken from the first conversation of their ``group``; h = crc32(conv_id) % heads. The remainder of a negative id is negative, as in SQL."""
    base = arrays.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    rows = arrays.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base.hint("merge"), "base", "left").withColumn("h", h)
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(F.slice("turns", 1, 0))
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


class _Node:
    """An open prefix: what is known of it so far."""

    __slots__ = ("node", "parent", "depth", "words", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "held", "seq", "spine")

    def __init__(self, node: bytes, parent: bytes | None, depth: int, words: int, spine: bool):
        self.node, self.parent, self.depth, self.words, self.spine = node, parent, depth, words, spine
        self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved = None, 0, 0, 0, 0
        self.held, self.seq = [], 0

    def meet(self, conv_id: int | None, n: int) -> None:
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id
        self.n_convs += n

    def finish(self) -> None:
        """The counts of a node all of whose children are in."""
        self.n_leaves = self.n_leaves if self.n_children else 1
        self.saved += (self.n_convs - 1) * self.words

    def into(self, parent: _Node) -> None:
        parent.meet(self.conv_id, self.n_convs)
        parent.n_children += 1
        parent.n_leaves += self.n_leaves
        parent.saved += self.saved


def _child(parent: bytes, key: bytes) -> bytes:
    return hashlib.sha256(parent + key).digest()[:KEY_BYTES]


class _Rows:
    """Rows of SWEPT on their way out, in batches."""

    def __init__(self, part: int):
        self.part, self.rows = part, []

    def put(self, kind: str, seq: int, x: _Node, ends: str | None = None, ids: str | None = None) -> None:
        self.rows.append((self.part, kind, seq, x.node, x.parent, x.depth, x.words, x.conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved, ends, ids))

    def batches(self, most: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _FIELDS)], schema=_FIELDS)
            self.rows = []


def _sweep_range(conversations: Iterator[tuple[int, int, list[bytes], list[int]]], chunk_ids: int) -> Iterator[pa.RecordBatch]:
    """SWEPT rows of one sorted range of (part, conv_id, keys, words)."""
    stack: list[_Node] = []
    before: list[bytes] = []
    out = None

    def flush(x: _Node) -> None:
        if x.held:
            out.put("ids", x.seq, x, ids=",".join(map(str, x.held)))
            x.seq, x.held = x.seq + 1, []

    def close() -> None:
        x = stack.pop()
        if x.spine:  # may go on in the range before: only its own part is known, and its ids must follow others
            flush(x)
            out.put("left", x.depth, x)
            return
        ends = None
        if x.seq:
            flush(x)
        else:
            ends = hashlib.sha256(",".join(map(str, x.held)).encode()).hexdigest() if x.held else NO_ENDS
        x.finish()
        out.put("node", 0, x, ends)
        x.into(stack[-1])

    for part, conv_id, keys, words in conversations:
        if out is None:
            out = _Rows(part)
        common = 0
        while common < min(len(keys), len(before)) and keys[common] == before[common]:
            common += 1
        first = not stack
        while len(stack) > common + 1:
            close()
        if first:
            stack.append(_Node(ROOT, None, 0, 0, True))
        for d in range(common, len(keys)):
            stack.append(_Node(_child(stack[-1].node, keys[d]), stack[-1].node, d + 1, words[d], first))
        top = stack[-1]
        top.meet(conv_id, 1)
        top.held.append(conv_id)
        if len(top.held) >= chunk_ids:
            flush(top)
        before = keys
        yield from out.batches(5000)
    if out is None:
        return
    for x in stack:  # the prefixes of the last conversation
        flush(x)
        out.put("right", x.depth, x)
    yield from out.batches(0)


def sweep(sorted_rows: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """SWEPT rows of conversations (part, conv_id, turns) that lie sorted in their partitions."""

    def run(batches):
        def rows():
            for batch in batches:
                part, conv, turns = batch.columns
                for i in range(batch.num_rows):  # one conversation at a time is Python objects
                    own = turns[i].values
                    yield part[i].as_py(), conv[i].as_py(), own.field("key").to_pylist(), own.field("words").to_pylist()

        yield from _sweep_range(rows(), chunk_ids)

    return sorted_rows.mapInArrow(run, SWEPT)


def _stitched(rows: Iterator[dict]) -> Iterator[tuple[_Node, int]]:
    """The nodes open at range ends, whole; ``rows`` are left and right rows by range, kind and depth.

    Each range gives the prefixes of its first conversation that closed within it (left) and
    those of its last one (right). A prefix of both is right. Read as paths, the stacks of
    neighbouring ranges agree down to their LCP.
    """
    stack: list[_Node] = []

    def close() -> _Node:
        x = stack.pop()
        x.finish()
        if stack:
            x.into(stack[-1])
        return x

    def add(row: dict) -> Iterator[_Node]:
        while len(stack) > row["depth"] and stack[row["depth"]].node != row["node"]:
            yield close()
        if len(stack) <= row["depth"]:
            stack.append(_Node(row["node"], row["parent"], row["depth"], row["words"], False))
        x = stack[row["depth"]]
        x.meet(row["conv_id"], row["n_convs"])
        x.n_children += row["n_children"]
        x.n_leaves += row["n_leaves"]
        x.saved += row["saved"]

    for row in rows:
        yield from add(row)
    while stack:
        yield close()


def stitch(swept: DataFrame) -> DataFrame:
    """The complete node rows of SWEPT for the prefixes that are open at range ends.

    A range's rows come as one path down to its first conversation's end, then one down to
    its last one's. Prefixes that both share are opened first, so the left path comes with
    the shared prefixes above it.
    """

    def run(batches):
        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        out = _Rows(-1)
        for x in _stitched(rows()):
            out.put("node", 0, x)
            yield from out.batches(5000)
        yield from out.batches(0)

    open_nodes = swept.filter("kind in ('left', 'right')")
    # In a range the shared prefixes are right rows above every left row: by depth among the
    # left path first, then the rest of the right path.
    deepest = F.col("at").isNotNull() & (F.col("kind") == "right") & (F.col("depth") >= F.col("at"))
    at = open_nodes.filter("kind = 'left'").groupBy("part").agg(F.min("depth").alias("at"))
    ordered = open_nodes.join(F.broadcast(at), "part", "left").withColumn("late", F.coalesce(deepest, F.lit(False)))
    return ordered.repartition(1).sortWithinPartitions("part", "late", "depth").drop("at", "late").mapInArrow(run, SWEPT)


def _hash_ids(chunks: DataFrame) -> DataFrame:
    """node, ends_sha256 of all ids of a node in order, read as a stream."""

    def run(batches):
        node, state, done = None, None, []
        for batch in batches:
            for own, ids in zip(batch.column("node"), batch.column("ids")):
                if own.as_py() != node:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = own.as_py(), hashlib.sha256()
                    state.update(ids.as_py().encode())
                else:
                    state.update(b"," + ids.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], names=["node", "ends_sha256"])
                done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    ordered = chunks.repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "ids")
    return ordered.mapInArrow(run, "node binary, ends_sha256 string")


def trie(arrays: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """The nodes of conversations (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node, parent (hexadecimal names)."""
    keys = F.transform("turns", lambda t: t["key"])
    table = materialize(arrays.withColumn("keys", keys), "arrays")
    ranges = table.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id").select(F.spark_partition_id().alias("part"), "conv_id", "turns")
    swept = materialize(sweep(ranges, chunk_ids), "swept")
    nodes = swept.filter("kind = 'node'").unionByName(stitch(swept))
    hashed = materialize(_hash_ids(swept.filter("kind = 'ids'")), "ends")
    ends = F.coalesce(nodes["ends_sha256"], hashed["ends_sha256"], F.lit(NO_ENDS))
    nodes = nodes.join(hashed.hint("merge"), nodes["node"] == hashed["node"], "left").select(
        nodes["node"], nodes["parent"], "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", ends.alias("ends_sha256")
    )
    nodes = materialize(nodes, "nodes")
    discard(table, swept, hashed)
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    rows = heavy_join(nodes.filter("parent is not null"), parents, ["parent"], "n_children", nodes.count())
    root = nodes.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return rows.unionByName(root).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256",
        F.lower(F.hex("node")).alias("node"), F.lower(F.hex("parent")).alias("parent"),
    )


def conversation_trie(convs: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(materialize(turn_arrays(convs), "turns")))


def oracle() -> str:
    """The nodes by DuckDB: prefixes are grouped as lists, subtrees are joined through all prefixes of every node."""
    return r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
k as (select conv_id, turn, sha256(strlen(role) || ':' || role || text)[1:32] as key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from t),
a as materialized (select conv_id, list({'k': key, 'w': words} order by turn nulls first, key) as own from k group by conv_id),
h as (select conv_id, own, (4294967295 - list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(string_split(cast(conv_id as varchar), ''),
  lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))), lambda crc, bit: xor(crc >> 1, cast(3988292384 as bigint) * (xor(crc, bit) & 1)))) % 4 as h from a),
r as materialized (select h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h), []), list_slice(h.own, h + 1, len(h.own))) as seq
  from h left join a b on b.conv_id = h.conv_id - h.conv_id % 20),
p as (select conv_id, d, len(seq) = d as ended, case when d > 0 then seq[d].w else 0 end as words,
  list_transform(range(d + 1), lambda i: md5(array_to_string(list_transform(seq[1:i], lambda x: x.k), ','))) as ids from (select conv_id, seq, unnest(range(len(seq) + 1)) as d from r)),
n as materialized (select ids[d + 1] as id, d, case when d > 0 then ids[d] end as parent, any_value(ids) as ids, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(words) as saved,
  sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ended), '')) as ends_sha256 from p group by all),
ch as (select parent, count(*) as n_children from n where parent is not null group by parent),
su as (select top, cast(sum(saved) as bigint) as saved_tokens, count(*) filter (n_children is null) as n_leaves
  from (select unnest(ids) as top, id, saved from n) x left join ch on ch.parent = x.id group by top)
select n.conv_id, cast(n.d as bigint) as depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, n.ends_sha256
from n left join ch on ch.parent = n.id join su on su.top = n.id left join n q on q.id = n.parent
"""
