import random

import pytest
from compare import SF, duck_rows, spark_rows

from stratafold.llm import decontaminate, license_scan, queries
from stratafold.llm.text import ASCII_LOWER, WORD


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(queries.oracle_sql()[name])


def test_license_odd_rows(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in license_scan.scan(odd_docs).collect()}
    assert license_scan.scan(odd_docs).count() == odd_docs.count() and license_scan.scan(no_docs).count() == 0
    assert (got[8]["n_base"], got[8]["first_word"], got[8]["last_word"], got[8]["base_labels"]) == (2, 3, 7, "gpl,mit")
    assert (got[1]["n_words"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (0, None, "", 0.0)


def test_license_templates_without_phrases(spark):
    text = "x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    rows = spark.createDataFrame([(1, text), (2, "licensed under cc by nc 4 0 today"), (3, "the mit\nlicense"), (4, "permission is free")], "doc_id long, text string")
    got = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in license_scan.scan(rows).collect()}
    assert got == {1: ("", "mit"), 2: ("", "cc-by-nc"), 3: ("mit", "mit"), 4: ("", "")}


def test_wrapped_notices(spark):
    mit = "x\n# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\n\nconditions are met"
    far = " filler" * 60
    rows = [(1, mit), (2, bsd), (3, "word " * 900 + bsd + far), (4, bsd.replace("binary", "binary" + "\nx" * 40)), (5, "licensed\nunder cc\nby nc\n4 0")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("bsd", 1.0), 4: ("", 0.0), 5: ("cc-by-nc", 1.0)}


def test_windows_against_brute_force(spark):
    rng = random.Random(4)
    templates = [("a", "p q r s t"), ("b", "q q u v w x y")]
    docs = [(i, "".join(rng.choice("pqrstuvwxyz") + rng.choice("  \n") for _ in range(rng.randint(0, 50)))) for i in range(60)]
    want = {}
    for doc, text in docs:
        w = text.split()
        for k, (_, t) in enumerate(templates):
            t = t.split()
            n, size = len(set(t)), -(-5 * len(t) // 4)
            best = max((len(set(t) & set(w[i : i + size])) for i in range(len(w))), default=0)
            if best >= 0.8 * n - 1e-9:
                want[doc, k] = best / n
    found = license_scan.containment_join(spark.createDataFrame(docs, "doc_id long, text string"), templates)
    assert want and {(r["doc_id"], r["template"]): r["containment"] for r in found.collect()} == want


def test_filters_prune(spark):
    """Of 200 texts with stray words of the notices the positional filter drops nearly all that the prefix filter reaches."""
    rng = random.Random(8)
    stray = sorted({w for _, t in license_scan.TEMPLATES for w in WORD.findall(t.translate(ASCII_LOWER))})
    texts = [" ".join(rng.choice(stray) if rng.random() < 0.1 else f"w{rng.randrange(500)}" for _ in range(300)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, license_scan.TEMPLATES[1][1])], "doc_id long, text string")
    found = license_scan.places(docs, license_scan.ranked_templates(docs, license_scan.TEMPLATES, 0.8))
    reached, left = found.count(), found.filter("left >= need").select("doc_id").collect()
    assert reached > 1000 and len(left) < reached / 5 and 900 in {r["doc_id"] for r in left}
    assert {(r["doc_id"], r["label"]) for r in license_scan.containment_join(docs).collect()} == {(900, "mit")}


def test_rows_are_judged_by_their_own_text(spark):
    notice = "Licensed under CC BY-NC 4.0."
    rows = [(1, notice), (1, "nothing here to see"), (None, notice), (None, None), (2, "licensed " + "x " * 30 + "under cc by nc 4 0")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in got) == [(0, ""), (0, "cc-by-nc"), (1, ""), (1, "cc-by-nc"), (2, "cc-by-nc")]
    assert [r["score"] for r in got if r["doc_id"] == 2] == [pytest.approx(6 / 7)]


def by_hand(docs, items, window=10):
    split = lambda t: WORD.findall((t or "").translate(ASCII_LOWER))
    wins = [(i, tuple(w[k : k + window]) if len(w) >= window else tuple(w)) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - window + 1))]
    out = {}
    for doc, t in docs:
        w, hit, ids = split(t), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(item)
        out[doc] = (len(w), len(hit), len(ids))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontaminate_random_small_alphabet(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, say(rng.randint(0, 60))) for i in range(40)] + [(100, None), (101, "")]
    items = [(i, say(rng.choice([1, 3, 6, 9, 10, 12, 25]))) for i in range(12)] + [(50, None), (51, ""), (3, say(11))]
    frame = lambda rows, a: spark.createDataFrame(rows, f"{a} long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == by_hand(docs, items)


def test_decontaminate_repeated_and_null_ids(spark):
    item = " ".join(f"q{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, "clean text"), (None, item), (None, "clean"), (2, " ".join(["same"] * 400))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (8, " ".join(["same"] * 60)), (9, "same")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(docs, items).collect())
    assert got == [(0, 1, 0, 0), (0, 14, 14, 1), (1, 2, 0, 0), (1, 16, 14, 1), (2, 400, 400, 2)]


def test_decontaminate_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "word5 x5 word6 x6 word7 x7 word8 x8 word9 x9 word10 x10"), (None, "null id text"), (2, None)], "item_id long, text string")
    got = decontaminate.decontaminate(odd_docs, items).collect()
    assert len(got) == odd_docs.count() and {r["doc_id"] for r in got if r["contaminated"]} == {6, 7, None}
    assert decontaminate.decontaminate(no_docs, items).count() == 0
    assert not decontaminate.decontaminate(odd_docs, items.limit(0)).filter("contaminated").count()


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontaminate_repetitive_texts(spark, monkeypatch, limit):
    """One word over and over on both sides: one fingerprint, one window, one pair, however long the texts are."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    long = " ".join(f"u{i % 3000}" for i in range(9000))
    docs = spark.createDataFrame([(1, "the " * 200_000), (2, "the " * 9), (3, f"start {long} end"), (4, "b " + "the " * 30 + "a b a b a b a b a b a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the " * 20_000), (2, "a b " * 2000), (3, long), (4, "the the")], "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(docs, items).collect())
    assert got == [(1, 200_000, 200_000, 2), (2, 9, 9, 1), (3, 9002, 9000, 1), (4, 43, 42, 3)]


def test_decontaminate_windows_in_every_document(spark):
    """A benchmark of several thousand windows, one of which every document holds."""
    rng = random.Random(4)
    common = " ".join(f"c{i}" for i in range(10))
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + (f" {common}" if i % 2 else "")) for i in range(100)]
    docs = [(i, f"d{i} e{i} {common} f{i}") for i in range(300)] + [(900, items[6][1]), (901, "nothing " * 12)]
    frame = lambda rows, a: spark.createDataFrame(rows, f"{a} long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == {i: (13, 10, 50) for i in range(300)} | {900: (60, 60, 1), 901: (12, 0, 0)}
