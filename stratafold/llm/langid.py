"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over them, each filter keeps its
largest response in a fixed-length window, and a softmax layer names the language. The
windows of a text tile all of it; their logits are averaged. For prediction the embedding
and the filters are folded into tables by byte and byte pair, so that a response is a sum
of table rows.

Bound: the network is fitted on at most ``sample`` documents, taken by hash of doc_id, and
``windows_per_doc`` windows of each, spread over the whole text. Every text is predicted
whole.

Defined results: null text and text without a letter is ``und`` with score 0, as is all
text when there is no labelled row; repeated rows are predicted alike; an empty table gives
no rows; columns beside doc_id, text and lang are ignored, and only text is an input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Bytes predicted at once; a multiple of the window.
STRIDE = 16 * WINDOW
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_LETTER = re.compile(r"[^\W\d_]")
REACH = max(WIDTHS) - 1


def windows(raw: bytes, most: int | None = None) -> np.ndarray:
    """The text's windows of WINDOW + REACH bytes, zero-padded; ``most`` picks some, evenly spread."""
    raw = raw.translate(_LOWER)
    n = max(1, -(-len(raw) // WINDOW))
    picked = range(n) if most is None or n <= most else np.linspace(0, n - 1, most).astype(int)
    out = np.zeros((len(picked), WINDOW + REACH), np.uint8)
    for row, i in enumerate(picked):
        part = raw[i * WINDOW : (i + 1) * WINDOW + REACH]
        out[row, : len(part)] = np.frombuffer(part, np.uint8)
    return out


@dataclass
class Network:
    langs: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(langs))), "bias": np.zeros(len(langs))}
        for w in WIDTHS:
            p[f"filter{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            p[f"shift{w}"] = np.zeros(FILTERS)
        return cls(langs, {k: v.astype(np.float32) for k, v in p.items()})

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients on windows x with label indexes y."""
        p, n = self.p, len(x)
        e = p["embed"][x]
        pooled, where, grown = [], [], []
        for w in WIDTHS:
            columns = np.concatenate([e[:, o : o + WINDOW] for o in range(w)], axis=2)
            responses = columns @ p[f"filter{w}"]
            at = responses.argmax(1)
            pooled.append(np.take_along_axis(responses, at[:, None, :], 1)[:, 0] + p[f"shift{w}"])
            where.append(at)
            grown.append(columns)
        a = np.maximum(np.concatenate(pooled, 1), 0)
        logits = a @ p["out"] + p["bias"]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        loss = -np.log(prob[np.arange(n), y] + 1e-9).mean()
        d = prob
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": a.T @ d, "bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
        back = (d @ p["out"].T) * (a > 0)
        for k, w in enumerate(WIDTHS):
            b = back[:, k * FILTERS : (k + 1) * FILTERS]
            best = np.take_along_axis(grown[k], where[k][:, :, None], 1)  # window, filter, width * embed
            g[f"filter{w}"] = np.einsum("nfc,nf->cf", best, b)
            g[f"shift{w}"] = b.sum(0)
            spread = b[:, :, None] * p[f"filter{w}"].T[None]
            for o in range(w):
                byte = np.take_along_axis(x, where[k] + o, 1)
                np.add.at(g["embed"], byte, spread[:, :, o * EMBED : (o + 1) * EMBED])
        return float(loss), g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 2) -> None:
        """Adam over random batches, each language drawn alike."""
        rng = np.random.default_rng(seed)
        share = 1 / np.bincount(y, minlength=len(self.langs))[y]
        share /= share.sum()
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(z) for k, z in self.p.items()}
        for t in range(1, steps + 1):
            pick = rng.choice(len(x), batch, p=share)
            _, g = self.step(x[pick], y[pick])
            scale = rate * (1 - t / (steps + 1))
            for k, z in g.items():
                m[k] = 0.9 * m[k] + 0.1 * z
                v[k] = 0.99 * v[k] + 0.01 * z * z
                self.p[k] = (self.p[k] - scale * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)

    def fold(self) -> None:
        """Tables of filter responses by byte pair: the first two bytes, then the rest by width."""
        e = self.p["embed"]
        one = lambda w, o: e @ self.p[f"filter{w}"][o * EMBED : (o + 1) * EMBED]
        pair = lambda w, o: (one(w, o)[None, :, :] + one(w, o + 1)[:, None, :]).reshape(65536, FILTERS)
        self.first = np.ascontiguousarray(np.concatenate([pair(w, 0) for w in WIDTHS], 1), np.float32)
        self.third, self.last = one(3, 2).astype(np.float32), np.ascontiguousarray(pair(4, 2), np.float32)

    def logits(self, raw: bytes) -> np.ndarray:
        """Mean logits over the windows of a whole text, in pieces of STRIDE bytes."""
        b = np.frombuffer(raw.translate(_LOWER), np.uint8)
        n = max(1, -(-len(b) // WINDOW))
        padded = np.zeros(n * WINDOW + REACH, np.uint8)
        padded[: len(b)] = b
        pairs = padded[:-1].astype(np.int32) | padded[1:].astype(np.int32) << 8
        shift = np.concatenate([self.p[f"shift{w}"] for w in WIDTHS])
        total = np.zeros(len(self.langs))
        for lo in range(0, n * WINDOW, STRIDE):
            hi = min(lo + STRIDE, n * WINDOW)
            r = self.first[pairs[lo:hi]]
            r[:, FILTERS : 2 * FILTERS] += self.third[padded[lo + 2 : hi + 2]]
            r[:, 2 * FILTERS :] += self.last[pairs[lo + 2 : hi + 2]]
            pooled = np.maximum(r.reshape(-1, WINDOW, r.shape[1]).max(1) + shift, 0)
            total += (pooled @ self.p["out"] + self.p["bias"]).sum(0)
        return total / n

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        z = self.logits(text.encode("utf-8", "surrogatepass"))
        prob = np.exp(z - z.max())
        prob /= prob.sum()
        best = int(prob.argmax())
        return self.langs[best], float(prob[best])


def held_out_third(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 == 1


def fit(docs: DataFrame, sample: int = 3000, windows_per_doc: int = 3) -> Network:
    known = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out_third(F.col("doc_id")))
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids: a broadcast of proven size. Only windows of fixed length reach the driver.
    texts = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            out = [
                (doc, lang, row.tobytes())
                for doc, lang, text in zip(*[c.to_pylist() for c in batch.columns]) if _LETTER.search(text)
                for row in windows(text.encode("utf-8", "surrogatepass"), windows_per_doc)
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "lang", "window"])

    chosen = texts.join(F.broadcast(ids.distinct()), "doc_id").select(F.col("doc_id").cast("long"), "lang", "text")
    rows = sorted((r["doc_id"], r["lang"], bytes(r["window"])) for r in chosen.mapInArrow(run, "doc_id long, lang string, window binary").collect())
    langs = sorted({lang for _, lang, _ in rows})
    network = Network.fresh(langs)
    if len(langs) > 1:
        x = np.frombuffer(b"".join(w for _, _, w in rows), np.uint8).reshape(len(rows), WINDOW + REACH)
        network.train(x, np.array([langs.index(lang) for _, lang, _ in rows]))
    network.fold()
    return network


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    network = fit(docs, **options)
    sent = docs.sparkSession.sparkContext.broadcast((network.langs, network.p))

    def run(batches):
        local = Network(*sent.value)
        local.fold()
        for batch in batches:
            found = [local.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out_third(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
