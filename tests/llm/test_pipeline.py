from compare import SF

import corpus_pipeline
from stratafold.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity


def test_stages_do_what_their_operators_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables, now = [docs], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        tables.append(now)
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and all(t.columns == docs.columns for t in tables[:-1])
    toxic = {r["doc_id"] for r in toxicity.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    assert ids[1] == ids[0] - toxic
    deduped = {r["doc_id"]: r for r in line_dedup.dedup(tables[1]).collect()}
    assert {r["doc_id"]: r["text"] for r in tables[2].collect()} == {i: r["text"] for i, r in deduped.items() if not r["n_deleted"] or r["text"].split()}
    assert ids[3] == {r["doc_id"] for r in ngram_join.components(tables[2]).filter("doc_id = component_id").collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids[4] == {r["doc_id"] for r in decontaminate.decontaminate(tables[3], items).filter("not contaminated").collect()}
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, mixing.mix(tables[4]).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, now.collect()))


def test_odd_rows(spark, odd_docs, no_docs):
    """Every stage by itself on nulls, empties, repeats and an empty table."""
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    rows = lambda df: sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "", r["source"] or "") for r in df.collect())
    whole = rows(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, SF)
        assert out.columns == docs.columns and stage(spark, no_docs, SF).count() == 0
        got = rows(out)
        if name == "line dedup":  # 7 is a copy of 6; rows of one doc_id are not compared; line 5 has too few words
            assert got == [r for r in whole if r[1] != 7]
        elif name == "n-gram Jaccard join":  # 5 is 4 but for case and spaces
            assert got == [r for r in whole if r[1] not in (5, 7)]
        else:
            assert got == whole
    got = corpus_pipeline.STAGES[-1][1](spark, odd_docs, SF).collect()
    assert len(got) == len(whole) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, SF).count() == 0


def test_planted_cases(spark):
    """Copies, benchmark passages and repeated passages planted among clean documents are found, the clean ones stay."""
    base = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 1500").orderBy("doc_id").limit(12).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = [(10**6 + i, " ".join(f"{chr(97 + i)}{k}" for k in range(300))) for i in range(8)]
    words = base[0].split()
    rows = [(10**6 + 100, base[0]), (10**6 + 101, base[0]), (10**6 + 102, " ".join([*words[:-3], "end"])), (10**6 + 103, " ".join(f"z{k}" for k in range(40)) + " " + item)]
    docs = spark.createDataFrame([(d, t, "en", "planted", len(t)) for d, t in clean + rows], "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda df: {r["doc_id"] - 10**6 for r in df.select("doc_id").collect()}
    stages = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert ids(stages["n-gram Jaccard join"]) == {*range(8), 100, 103} and ids(stages["benchmark decontamination"]) == {*range(8), 100, 101, 102}
    assert ids(stages["line dedup"]) >= {*range(8), 100} and 101 not in ids(stages["line dedup"])
