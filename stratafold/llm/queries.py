"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from stratafold.llm import decontaminate, exact_dedup, gif_media, html_extract, langid, lexical, license_scan, line_dedup, mixing, ngram_join, prefix_trie, toxicity, warc


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_gif_media(spark, sf_dir):
    return gif_media.read_back(gif_media.store(_table(spark, sf_dir, "documents")))


def gif_frames(spark, sf_dir):
    """The timed frames of operator 3 with their colour histograms."""
    return gif_media.decode_frames(gif_media.store(_table(spark, sf_dir, "documents"))).drop("pixels")


def op4_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark, sf_dir):
    return ngram_join.components(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc(spark, sf_dir):
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op8_line_dedup(spark, sf_dir):
    return line_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_deleted", "text")


def op9_html_extract(spark, sf_dir):
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op10_mix_sources(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    """The nodes without their internal names."""
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations")).drop("node", "parent")


def op12_lexical_search(spark, sf_dir):
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_license_scan, op2_decontaminate, op3_gif_media, op4_language_id, op5_ngram_join, op6_toxicity, op7_warc, op8_line_dedup, op9_html_extract, op10_mix_sources, op11_prefix_trie, op12_lexical_search, op13_exact_dedup, pipeline, gif_frames)}


def oracle_sql():
    return {"op1_license_scan": license_scan.oracle(), "op2_decontaminate": decontaminate.oracle(), "op7_warc": warc.oracle(), "op11_prefix_trie": prefix_trie.oracle(), "op12_lexical_search": lexical.oracle(), "op13_exact_dedup": exact_dedup.oracle()}
