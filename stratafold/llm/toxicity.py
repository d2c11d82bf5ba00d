"""Toxicity by nearest labelled examples.

A text is its whole TF-IDF vector over all words. Words that stand in toxic examples much
more often than in clean ones are telling: they weigh more, and telling beginnings of words
and terms that say how many words of the text are telling come beside them; no word is left
out. Document frequencies are counted over all documents; a word that no example holds
counts in the length of the vector as one that no document holds. Each document is scored
against its nearest labelled examples by exact cosine, found with a block-max inverted
index: examples lie in blocks, terms have lists and largest weights per block, the blocks of
the highest bounds are visited first, then all whose bound allows a nearer example.
Distance-weighted votes, corrected for the share of each class in the sample, pass through
an isotonic calibration that was fitted leaving each example out. The nearest examples, all
k of them, are the evidence.

Bound: at most ``per_class`` examples of each label are fitted, taken by hash of doc_id, and
of these as many in that order as hold ``most_bytes`` of text together (one that does not
fit is passed over); the labels' prior and the document frequencies cover everything. Of
rows that share a doc_id one is an example. The driver gets the words of the examples with
their counts, the tasks the fitted model as one broadcast variable.

Defined results: null or empty text, and text that shares no word with an example, get the
share of toxic examples among those without words; conflicting labels of one doc_id count as toxic;
null labels are ignored; without examples of both labels all scores are the prior (0 with
no labels); repeated rows are scored alike; an empty table gives no rows; other columns of
the documents are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.scratch import discard, materialize

#: Lower-cases A-Z; a byte that no word holds becomes a space.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
STARTS = range(4, 10)
#: Terms of their own: whether at least so many words of a text hold a telling feature.
AMOUNTS = (2, 3, 4, 6, 9, 14, 25)
BLOCK = 32
#: Terms that most examples hold, kept as dense rows of the blocks instead of lists.
HEAD = 256
#: Texts that are scored together.
BATCH = 64
#: How much more a telling feature weighs than another of the same frequency.
FAVOUR = 4.0


def beginnings(word: bytes) -> list[bytes]:
    """The beginnings of a word in bytes, each ending in a zero byte, which no word holds."""
    return [word[:n] + b"\0" for n in STARTS if n < len(word)]


def text_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


Vector = tuple[np.ndarray, np.ndarray]  # terms and their weights


class Index:
    """Unit vectors of examples by block, for exact nearest neighbours by cosine.

    Terms have inverted lists, but for the ``HEAD`` commonest, which are dense rows. A list
    is cut where its examples pass into another block, and each piece states its largest
    weight. The bound of a block is the sum of these maxima plus, for the dense terms, that
    of their largest weights in the block. Blocks whose bound falls short of the k-th best
    cosine known stay unread; of the others the pieces are read, and where these with the
    dense maxima still reach it, the dense part is computed. ``pieces`` counts the pieces
    met and read.
    """

    def __init__(self, vectors: list[Vector], ids: list[int]):
        # Examples whose heaviest terms agree lie together, so that bounds are tight.
        heaviest = [int(t[np.lexsort((t, -w))[0]]) for t, w in vectors]
        order = sorted(range(len(ids)), key=lambda i: (heaviest[i], ids[i]))
        self.ids, self.vectors = [ids[i] for i in order], [vectors[i] for i in order]
        self.blocks = -(-len(ids) // BLOCK)
        terms, weights = (np.concatenate([v[k] for v in self.vectors]) if ids else np.zeros(0, int) for k in (0, 1))
        place = np.repeat(np.arange(len(ids)), [len(t) for t, _ in self.vectors])
        self.width = int(terms.max()) + 1 if len(terms) else 0
        held = np.bincount(terms, minlength=self.width)
        head = np.argsort(-held, kind="stable")[:HEAD]
        self.head_of = np.full(self.width, -1)
        self.head_of[head] = np.arange(len(head))
        dense = self.head_of[terms] >= 0
        self.dense = np.zeros((len(head), self.blocks * BLOCK))
        self.dense[self.head_of[terms[dense]], place[dense]] = weights[dense]
        self.most = self.dense.reshape(len(head), self.blocks, BLOCK).max(2) if ids else np.zeros((0, 0))
        terms, weights, place = terms[~dense], weights[~dense], place[~dense]
        by_term = np.lexsort((place, terms))
        terms, self.places, self.weights = terms[by_term], place[by_term].astype(np.int32), weights[by_term]
        block = self.places // BLOCK
        starts = np.flatnonzero(np.r_[True, (np.diff(terms) != 0) | (np.diff(block) != 0)][: len(terms)])
        self.piece_at = np.append(starts, len(terms))
        self.piece_block = block[starts]
        self.piece_most = np.maximum.reduceat(self.weights, starts) if len(starts) else np.zeros(0)
        self.ends = np.searchsorted(terms[starts], np.arange(self.width + 1))
        self.pieces = [0, 0]

    def __getstate__(self):
        # The examples' own vectors serve the calibration only.
        return self.__dict__ | {"vectors": []}

    def nearest(self, queries: list[Vector], k: int, leave: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query the k largest (cosine, -place) above 0, ties to the earlier place; ``leave`` names a place to leave out."""
        count, blocks = len(queries), self.blocks
        if not count or not blocks:
            return [[] for _ in queries]
        owner = np.repeat(np.arange(count), [len(t) for t, _ in queries])
        terms, weights = (np.concatenate([q[i] for q in queries]) for i in (0, 1))
        keep = terms < self.width
        owner, terms, weights = owner[keep], terms[keep].astype(np.int64), weights[keep]
        head = self.head_of[terms]
        dense = head >= 0
        query = np.zeros((count, len(self.dense)))
        query[owner[dense], head[dense]] = weights[dense]
        owner, terms, weights = owner[~dense], terms[~dense], weights[~dense]
        n = self.ends[terms + 1] - self.ends[terms]
        at = np.arange(n.sum()) + np.repeat(self.ends[terms] - np.cumsum(n) + n, n)
        owner, weights = np.repeat(owner, n), np.repeat(weights, n)
        pair = owner * blocks + self.piece_block[at]
        rest = query @ self.most
        bound = rest + np.bincount(pair, weights * self.piece_most[at], count * blocks).reshape(count, blocks)
        sums = np.zeros((count, blocks, BLOCK))
        seen = np.zeros((count, blocks), bool)
        self.pieces[0] += len(at)

        def read(wanted: np.ndarray) -> None:
            """Adds the pieces of lists that lie in the blocks wanted."""
            mine = wanted.ravel()[pair]
            piece = at[mine]
            self.pieces[1] += len(piece)
            m = self.piece_at[piece + 1] - self.piece_at[piece]
            held = np.arange(m.sum()) + np.repeat(self.piece_at[piece] - np.cumsum(m) + m, m)
            key = np.repeat(owner[mine] * (blocks * BLOCK), m) + self.places[held]
            np.add(sums, np.bincount(key, np.repeat(weights[mine], m) * self.weights[held], sums.size).reshape(sums.shape), out=sums)

        def visit(wanted: np.ndarray) -> None:
            """Adds the dense part in the blocks wanted."""
            for b in np.flatnonzero(wanted.any(0)):
                rows = np.flatnonzero(wanted[:, b])
                sums[rows, b] += query[rows] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK]
            seen[wanted] = True

        first = np.argsort(-bound, axis=1, kind="stable")[:, : -(-(k + 1) // BLOCK) + 1]
        wanted = seen.copy()
        np.put_along_axis(wanted, first, True, 1)
        wanted &= bound > 0
        read(wanted)
        visit(wanted)
        known = np.where(seen[:, :, None], sums, 0.0)
        if leave is not None:
            known.reshape(count, -1)[np.arange(count), leave] = 0.0
        known = np.take_along_axis(known, first[:, :, None], 1).reshape(count, -1)
        least = np.partition(known, -k, 1)[:, -k] - 1e-11 if known.shape[1] >= k else np.zeros(count)
        # No other block whose bound is lower can hold a nearer example.
        wanted = ~seen & (bound > 0) & (bound >= least[:, None])
        read(wanted)
        visit(wanted & (rest + sums.max(2) >= least[:, None]))
        out = []
        for i in range(count):
            row = np.round(np.where(seen[i][:, None], sums[i], 0.0).ravel(), 12)
            if leave is not None:
                row[leave[i]] = 0.0
            places = np.flatnonzero(row > max(0.0, least[i]))
            order = np.lexsort((places, -row[places]))[:k]
            out.append([(float(row[p]), -int(p)) for p in places[order]])
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted non-decreasing least-squares fit (pool adjacent violators)."""
    pools: list[list[float]] = []  # value, weight, least x, largest x
    for a, b, c in sorted(zip(x.tolist(), y.tolist(), w.tolist())):
        if pools and pools[-1][3] == a:
            v, u, lo, _ = pools.pop()
            pools.append([(v * u + b * c) / (u + c), u + c, lo, a])
        else:
            pools.append([b, c, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, u, _, hi = pools.pop()
            p, q, lo, _ = pools.pop()
            pools.append([(v * u + p * q) / (u + q), u + q, lo, hi])
    return np.array([z for p in pools for z in (p[2], p[3])]), np.array([p[0] for p in pools for _ in range(2)])


class Codes(dict):
    """Words to terms. A word that no example holds is -2 if it begins with a telling beginning, else -1."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__(vocabulary)
        self.starts = {f[: STARTS[0]] for f in vocabulary if f.endswith(b"\0")}

    def of_beginnings(self, word: bytes) -> int:
        return -2 if word[: STARTS[0]] in self.starts and any(f in self for f in beginnings(word)) else -1

    __missing__ = of_beginnings


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    #: Of the vocabulary, those that toxic examples hold clearly more often.
    telling: frozenset[int]
    k: int
    prior: float
    idf: np.ndarray | None = None
    index: Index | None = None
    labels: list[int] = field(default_factory=list)
    weights: tuple[float, float] = (1.0, 1.0)
    bare: float = 0.0
    knots: tuple = ((0.0,), (0.0,))

    def __post_init__(self):
        self.codes = Codes(self.vocabulary)
        #: By code, also from the end: whether a word is telling or has a telling beginning.
        self.tells = np.zeros(len(self.vocabulary) + 2, bool)
        self.tells[-2] = True
        for word, i in self.vocabulary.items():
            self.tells[i] = i in self.telling or self.codes.of_beginnings(word) < -1

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "codes"}

    def __setstate__(self, state):
        self.__dict__ = state | {"codes": Codes(state["vocabulary"])}

    def coded(self, words) -> np.ndarray:
        """The code of every word: its term, or what ``Codes`` says of one that no example holds."""
        return np.array(list(map(self.codes.__getitem__, words)), np.int64)

    def features(self, telling: list[tuple[bytes, int]]) -> Counter:
        """The telling beginnings and the amounts that go with a text's telling words and their counts."""
        out: Counter = Counter()
        for word, n in telling:
            for f in beginnings(word):
                if f in self.vocabulary:
                    out[self.vocabulary[f]] += n
        hits = sum(n for _, n in telling)
        for k, amount in enumerate(AMOUNTS):
            if hits >= amount:
                out[len(self.vocabulary) + k] = 1
        return out

    def vector(self, words: dict[bytes, int]) -> Vector:
        """The unit vector of a text; words that no example holds count in its length only."""
        codes, counts = self.coded(words), np.fromiter(words.values(), float, len(words))
        terms = np.maximum(codes, -1)
        told = np.flatnonzero(self.tells[codes])
        if len(told):
            every = list(words)
            extra = self.features([(every[i], int(counts[i])) for i in told])
            terms, counts = np.r_[terms, list(extra)].astype(np.int64), np.r_[counts, list(extra.values())]
        weights = (1 + np.log(counts)) * self.idf[terms]  # place -1 holds the weight of a word that no document holds
        norm = math.sqrt((weights * weights).sum())
        known = terms >= 0
        return terms[known], weights[known] / norm if norm else weights[known]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic votes; each counts by its cosine and its class, with one vote for the prior."""
        mass = [self.prior, 1.0]
        for s, place in near:
            y = self.labels[-place]
            mass[0] += s * self.weights[y] * y
            mass[1] += s * self.weights[y]
        return mass[0] / mass[1]

    def scores(self, texts: pa.Array) -> list[tuple[float, list[tuple[float, int]]]]:
        """Score and evidence (cosine, doc_id) of whole texts in UTF-8; few of them are Python objects at a time."""
        out = []
        for at in range(0, len(texts), BATCH):
            part = texts.slice(at, BATCH).to_pylist()
            if self.index is None:
                out += [(self.bare, [])] * len(part)
                continue
            for near in self.index.nearest([self.vector(Counter(text_words(t))) for t in part], self.k):
                score = float(np.interp(self.vote(near), *self.knots)) if near else self.bare
                out.append((score, [(s, self.index.ids[-i]) for s, i in near]))
        return out


@dataclass
class Examples:
    """Labelled texts as counts of words; texts that share a word share its number."""

    words: list[bytes]
    ids: list[int]
    #: Per example the numbers of its words and how often they stand.
    held: list[np.ndarray]
    counts: list[np.ndarray]
    labels: list[int]

    def of(self, i: int) -> dict[bytes, int]:
        return {self.words[w]: c for w, c in zip(self.held[i].tolist(), self.counts[i].tolist())}


def choose_vocabulary(examples: Examples, least: int, most: int) -> tuple[dict[bytes, int], frozenset[int]]:
    """Every word of the examples, and the telling features.

    Telling are those that toxic examples hold clearly more often than clean ones, at most
    ``most``, strongest first; beginnings of words are features only where they are telling.
    """
    total = Counter(examples.labels)
    scored = []
    for n in (0, *STARTS):  # whole words, then beginnings of one length after the other
        feature = [w if not n else w[:n] + b"\0" if n < len(w) else None for w in examples.words]
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for y in (1, 0):
            for ids, label in zip(examples.held, examples.labels):
                if label == y:
                    found = {feature[i] for i in ids.tolist()}
                    held[y].update(found if y else found & held[1].keys())
        for f, a in held[1].items():
            if f is None or a < least:
                continue
            b = held[0][f]
            odds = math.log((a + 0.5) / (total[1] + 1)) - math.log((b + 0.5) / (total[0] + 1))
            error = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if odds - 2.5 * error > 1.0:
                scored.append((-(odds - 2.5 * error), f))
    telling = [f for _, f in sorted(scored)[:most]]
    vocabulary = {f: i for i, f in enumerate(telling + sorted(set(examples.words).difference(telling)))}
    return vocabulary, frozenset(range(len(telling)))


def training_rows(docs: DataFrame, labels: DataFrame, held_out, per_class: int, most_bytes: int) -> tuple[Examples, dict[int, int]]:
    """A sample of the labelled documents and the number of training labels by class, over all labels.

    Texts are counted where they lie; the driver gets the distinct words of at most
    2 * per_class examples with at most 2 * most_bytes of text.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).filter("toxic in (0, 1)")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = None
    for y in (0, 1):
        part = known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        pick = part if pick is None else pick.union(part)
    # At most 2 * per_class rows: a broadcast of proven size.
    rows = docs.select("doc_id", F.encode("text", "utf-8").alias("text")).join(F.broadcast(pick), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    rows = stored = materialize(rows.groupBy("doc_id", "toxic").agg(one.alias("text")), "examples")
    fitting, held = [], {0: 0, 1: 0}
    for doc, y, n in rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "toxic", F.coalesce(F.octet_length("text"), F.lit(0))).collect():
        if held[y] + n <= most_bytes:
            held[y] += n
            fitting.append((doc,))
    chosen = docs.sparkSession.createDataFrame(fitting, docs.select("doc_id").schema)
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    def count(batches):
        for batch in batches:
            words = [sorted(Counter(text_words(t.as_py())).items()) for t in batch.column(1)]
            spaced = pa.array([b" ".join(w for w, _ in c) for c in words], pa.binary())
            counts = pa.array([[n for _, n in c] for c in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), spaced, counts, batch.column(2)], names=["doc_id", "words", "counts", "toxic"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(count, "doc_id long, words binary, counts array<long>, toxic int").toArrow()
    discard(stored)
    numbers: dict[bytes, int] = {}
    out = Examples([], [], [], [], [])
    # Rows of one doc_id come in the order of their words, so that reruns agree.
    for doc, words, counts, y in sorted(zip(*[found.column(i).to_pylist() for i in range(4)])):
        out.ids.append(doc)
        out.held.append(np.array([numbers.setdefault(w, len(numbers)) for w in words.split()], np.int32))
        out.counts.append(np.array(counts, np.int32))
        out.labels.append(y)
    out.words = list(numbers)
    return out, totals


def held_out_fifth(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, held_out=held_out_fifth, per_class: int = 2000, k: int = 15, least: int = 4, most: int = 4000, most_bytes: int = 128 << 20) -> Model:
    examples, totals = training_rows(docs, labels, held_out, per_class, most_bytes)
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    model = Model(*choose_vocabulary(examples, least, most), k, prior, bare=prior)
    if not model.vocabulary or len(set(examples.labels)) < 2:
        return model
    n, df = document_frequencies(docs, model)
    learn(model, examples, totals, n, df)
    return model


def learn(model: Model, examples: Examples, totals: dict[int, int], n: int, df: np.ndarray) -> None:
    """Weights, index and calibration from the examples and the document frequencies."""
    seen = Counter(examples.labels)
    favoured = len(model.vocabulary)
    favour = np.ones(favoured + len(AMOUNTS))
    favour[[*model.telling, *range(favoured, len(favour))]] = FAVOUR
    model.idf = np.append((np.log((n + 1) / (df + 1)) + 1) * favour, math.log(n + 1) + 1)
    weights = (totals[0] / seen[0], totals[1] / seen[1])
    model.weights = tuple(w / (sum(weights) / 2) for w in weights)
    # The words of each example are all in the vocabulary, its own rare ones too.
    vectors = [(doc, model.vector(examples.of(i)), y) for i, (doc, y) in enumerate(zip(examples.ids, examples.labels))]
    full = [(doc, v, y) for doc, v, y in vectors if len(v[0])]
    if full:
        model.index = Index([v for _, v, _ in full], [doc for doc, _, _ in full])
        of = {doc: y for doc, _, y in full}
        model.labels = [of[doc] for doc in model.index.ids]
        places, votes = list(range(len(full))), []
        for at in range(0, len(full), BATCH):
            part = places[at : at + BATCH]
            votes += map(model.vote, model.index.nearest([model.index.vectors[i] for i in part], model.k, leave=part))
        y = np.array(model.labels, float)
        model.knots = isotonic(np.array(votes), y, np.array([model.weights[int(t)] for t in y]))
    bare = [model.weights[y] * np.array([y, 1.0]) for _, v, y in vectors if not len(v[0])]
    model.bare = float(sum(bare)[0] / sum(bare)[1]) if bare else model.prior


def document_frequencies(docs: DataFrame, model: Model) -> tuple[int, np.ndarray]:
    """Number of documents, and by term of those that hold it, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, n = shared.value, 0
        held = np.zeros(len(model.vocabulary) + len(AMOUNTS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                found = []
                for text in batch.column(0).slice(at, BATCH):
                    words = Counter(text_words(text.as_py()))
                    codes = model.coded(words)
                    found.append(codes)
                    told = np.flatnonzero(model.tells[codes])
                    if len(told):
                        every = list(words.items())
                        found.append(np.array(list(model.features([every[i] for i in told])), np.int64))
                found = np.concatenate(found)
                np.add.at(held, found[found >= 0], 1)
            n += batch.num_rows
        if n:
            f = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[f, -1]), pa.array(np.r_[held[f], n])], names=["f", "n"])

    found = docs.select(F.encode("text", "utf-8")).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    df = np.zeros(len(model.vocabulary) + len(AMOUNTS) + 1, np.int64)
    df[found.column("f").to_numpy()] = found.column("n").to_numpy()
    return int(df[-1]), df[:-1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence (nearest examples as id:cosine) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = shared.value.scores(batch.column(1))
            evidence = [",".join(f"{i}:{s:.4f}" for s, i in near) for _, near in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array(evidence, pa.string())], names=["doc_id", "score", "evidence"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "utf-8").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, evidence string")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row."""
    scored = score(docs, fit(docs, labels, **options))
    return scored.select(
        "doc_id", held_out_fifth(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence"
    )


def keep_below(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` with all their columns whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            keep = [s < threshold for s, _ in shared.value.scores(texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
