"""Benchmark decontamination by winnowing.

Of every run of ``window - k + 1`` consecutive k-gram hashes the smallest is kept as a
fingerprint. Two texts that share ``window`` words share a fingerprint, whatever stands
around, so the join of document and item fingerprints misses no pair. For each pair the
match is extended over the whole document: the hashes of all its windows are intersected
with those of the item's windows, and the windows that agree are compared word by word.
Items shorter than the window are one window each and are matched by the hash of their whole
length at every place, without winnowing. DataFrame functions only.

Scale: documents are read twice, once more where there are short items, whose lengths share
one pass; their text is shuffled once, by doc_id. Items are broadcast only when their words
are counted to be few; else fingerprints and texts are merge-joined, and fingerprints that
very many texts share are joined by broadcast, so none ends in one task. A text gives each
fingerprint once, however often it repeats, and a pair is one row, whatever the number of
places: work and memory for a pair follow the sum of the two lengths. A document's row
carries the words of each item it may hold once.

Defined results: null or empty text has no words and no hits; repeated items count once by
item_id, with the windows of all their texts; an item without item_id counts as one item
without a name; every row is judged by its own text, repeated doc_ids and a null doc_id too;
an empty table gives no rows, an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.text import words
from stratafold.operators.skew import heavy_join
from stratafold.scratch import materialize

#: Up to so many windows of benchmark text, the item side is broadcast.
BROADCAST_WINDOWS = 500_000


def _roll(a: Column, by: int, f) -> Column:
    """f(a[i], a[i + by]) for every i for which both exist."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n), f)


def _grams(df: DataFrame, n: int, of: str = "w", to: str = "g") -> DataFrame:
    """Column ``to``: a hash of the n words at every place of ``of``, built from hashes of 1, 2, 4, ... words."""
    df = df.withColumn(to, F.transform(of, lambda x: F.xxhash64(x)))
    have = 1
    while have < n:
        by = min(have, n - have)
        df = df.withColumn(to, _roll(F.col(to), by, lambda x, y: F.xxhash64(x, y)))
        have += by
    return df


def fingerprints(df: DataFrame, window: int, k: int) -> DataFrame:
    """The frame with w (at least ``window`` words) exploded to its different fingerprints fp."""
    df = _grams(df.filter(F.size("w") >= window), k)
    span, have = window - k + 1, 1
    while have < span:
        by = min(have, span - have)
        df = df.withColumn("g", _roll(F.col("g"), by, lambda x, y: F.least(x, y)))
        have += by
    return df.withColumn("fp", F.explode(F.array_distinct("g"))).drop("g")


def short_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """The frame with w exploded to n, shift and fp, a hash of the n words at every place, for all lengths at once."""
    df = df.withColumn("g1", F.transform("w", lambda x: F.xxhash64(x)))
    for n in range(2, max(lengths) + 1):  # one word more each time: the hashes of all lengths differ
        df = df.withColumn(f"g{n}", _roll_with(F.col(f"g{n - 1}"), F.col("g1"), n - 1))

    def placed(n: int) -> Column:
        return F.transform(f"g{n}", lambda x, i: F.struct(F.lit(n).alias("n"), i.alias("shift"), x.alias("fp")))

    every = F.concat(*map(placed, lengths))
    return df.withColumn("x", F.explode(every)).select(*[c for c in df.columns if not c.startswith("g")], "x.*")


def _roll_with(a: Column, one: Column, by: int) -> Column:
    """Hashes of (a[i], one[i + by]) for every i for which both exist."""
    n = F.greatest(F.size(one) - by, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(one, F.lit(by + 1), n), lambda x, y: F.xxhash64(x, y))


def matched(ours: DataFrame, theirs: DataFrame, on: list[str], few: bool) -> DataFrame:
    """The rows of documents with the items that have the same hashes."""
    if few:
        return ours.join(F.broadcast(theirs), on)
    # One row per hash with its items; how many documents hold it decides how it is joined.
    theirs = theirs.groupBy(*on).agg(F.collect_set("item").alias("items"))
    ours = materialize(ours.join(theirs.select(*on).hint("merge"), on, "left_semi"), "places")
    counted = ours.groupBy(*on).agg(F.count("*").alias("held")).join(theirs.hint("merge"), on)
    found = heavy_join(ours, materialize(counted, "fingerprints"), on, "held", ours.count())
    return found.withColumn("item", F.explode("items")).drop("items")


def hits(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 4) -> DataFrame:
    """id, tie, near: array of (item_id, words iw, window hashes gw, places at) to be compared, per text with any; a short item has places, a long one hashes."""
    items = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", F.array_join("w", " ")))
    facts = items.agg(F.sum(F.size("w")), F.collect_set(F.when(F.size("w") < window, F.size("w")))).first()
    few, short = (facts[0] or 0) <= BROADCAST_WINDOWS, sorted(facts[1] or [])
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), words(F.col("text")).alias("w"))
    theirs = fingerprints(items, window, k).select("fp", "item")
    found = matched(fingerprints(texts, window, k).select("id", "tie", "fp"), theirs, ["fp"], few).select("id", "tie", "item").distinct()
    found = found.withColumn("at", F.lit(None).cast("array<int>"))
    if short:
        theirs = short_grams(items.filter(F.size("w") < window), short).filter("n = size(w)").select("n", "fp", "item")
        ours = short_grams(texts, short).select("id", "tie", "n", "fp", "shift")
        places = matched(ours, theirs, ["n", "fp"], few).groupBy("id", "tie", "item").agg(F.collect_set("shift").alias("at"))
        found = found.unionByName(places)
    items = _grams(items, window, to="gw").select("item", "item_id", F.col("w").alias("iw"), F.array_distinct("gw").alias("gw"))
    found = found.join(F.broadcast(items) if few else items.hint("merge"), "item")
    return found.groupBy("id", "tie").agg(F.collect_list(F.struct("item_id", "iw", "gw", "at")).alias("near"))


def _text(w: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(w, start + 1, n), " ")


def judged(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """row (all columns of the document), w (its words), ids (of the items it holds windows of), spans (start and end of every such window); the last two are null where nothing was searched for."""
    found = hits(docs, items, window, k).hint("merge")
    rows = docs.select(F.struct("*").alias("row"))
    same = rows["row.doc_id"].eqNullSafe(found["id"]) & (F.xxhash64(rows["row.text"]) == found["tie"])
    rows = rows.join(found, same, "left").select("row", words(F.col("row.text")).alias("w"), "near")
    # Hashes of the document's windows, where an item may stand in it; those that an item has too.
    rows = _grams(rows.withColumn("searched", F.when(F.col("near").isNotNull(), F.col("w"))), window, "searched", "g")
    rows = rows.withColumn("common", F.array_intersect("g", F.flatten("near.gw")))
    # Named twice, so that no optimiser rule moves the intersection into the loop.
    starts = F.filter(F.transform("g", lambda x, i: F.when(F.array_contains("common", x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("starts", F.when(F.size("common") > 0, starts).when(F.col("common").isNotNull(), F.array().cast("array<int>")))
    # Word by word: the different texts of these windows against the windows of each item.
    rows = rows.withColumn("texts", F.array_distinct(F.transform("starts", lambda i: _text(F.col("w"), i, window))))

    def windows(d: Column) -> Column:
        last = F.size(d["iw"]) - window
        return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda j: _text(d["iw"], j, window)))).otherwise(F.array().cast("array<string>"))

    def held(d: Column) -> Column:
        n = F.size(d["iw"])
        return F.struct(
            d["item_id"].alias("item_id"), F.array_intersect("texts", windows(d)).alias("texts"),
            F.filter(F.coalesce(d["at"], F.array().cast("array<int>")), lambda i: F.slice("w", i + 1, n) == d["iw"]).alias("at"), n.alias("n"),
        )

    rows = rows.withColumn("held", F.filter(F.transform("near", held), lambda d: (F.size(d["texts"]) > 0) | (F.size(d["at"]) > 0)))
    rows = rows.withColumn("agreed", F.array_distinct(F.flatten("held.texts")))
    right = F.when(F.size("agreed") == F.size("texts"), F.col("starts")).otherwise(F.filter("starts", lambda i: F.array_contains("agreed", _text(F.col("w"), i, window))))
    span = lambda i, n: F.struct(i.alias("start"), (i + n).alias("end"))
    spans = F.concat(F.transform(right, lambda i: span(i, F.lit(window))), F.flatten(F.transform("held", lambda d: F.transform(d["at"], lambda i: span(i, d["n"])))))
    return rows.select("row", "w", F.col("held.item_id").alias("ids"), spans.alias("spans"))


def _covered(spans: Column) -> Column:
    """How many places lie in at least one of the spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, x):
        more = F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["n"])


def verdicts(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """id, tie (hash of the text), n_words, n_hit, ids (item_ids as strings) of every row, as a table.

    It is written before anybody filters it: the optimiser would push a filter on the spans
    through the steps that find them and repeat these inside each other's loops.
    """
    ids = F.array_sort(F.array_distinct(F.transform("ids", lambda i: i.cast("string"))))
    rows = judged(docs, items, window, k).select(
        F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("tie"), F.size("w").cast("long").alias("n_words"),
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"),
    )
    return materialize(rows, "verdicts")


def clean(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 4) -> DataFrame:
    """The rows of ``docs`` with all their columns that hold no window of an item."""
    bad = verdicts(docs, items, window, k).filter("n_hit > 0").select("id", "tie").distinct()
    every = docs.select(F.struct("*").alias("row"))
    same = every["row.doc_id"].eqNullSafe(bad["id"]) & (F.xxhash64(every["row.text"]) == bad["tie"])
    return every.join(bad, same, "left_anti").select("row.*")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 4) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    return verdicts(docs, items, window, k).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def oracle(window: int = 10) -> str:
    """The same rows in DuckDB: every window of the documents against every window of the items."""
    lower, word = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
with d as (select doc_id, regexp_extract_all({lower}, '{word}') as w from documents),
b as (select item_id, regexp_extract_all({lower}, '{word}') as w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[i + 1 : i + n], ' ') as win
  from (select item_id, w, least(len(w), {window}) as n, unnest(range(greatest(len(w) - {window}, 0) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') as win
  from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as i from d, lens where len(w) >= n)),
h as (select doc_id, i, dw.n, item_id from dw join bw on dw.win = bw.win and dw.n = bw.n),
spots as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as s
  from (select distinct doc_id, cast(item_id as varchar) as id from h) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join spots using (doc_id) left join ids using (doc_id)"""
