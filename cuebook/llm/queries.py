"""The contract queries of the operators that documents, embeddings and pages go through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebook.llm import language, neardup, ngram_join, toxicity
from cuebook.llm.common import table


def _crc(mod: int):
    """Remainder of the id's checksum; that of an empty text for a null id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod


def op1_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def language_model(spark, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    return language.train(docs.where(_crc(3) != 1))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language.identify(docs, *language_model(spark, sf_dir))
    return out.select("doc_id", (_crc(3) == 1).alias("held_out"), "lang_pred", "score", "langs")


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def toxicity_model(spark, sf_dir: str):
    labels = table(spark, sf_dir, "labels").where(_crc(4) != 2).select("doc_id", "toxic")
    return toxicity.train(table(spark, sf_dir, "documents"), labels)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return out.select("doc_id", (_crc(4) == 2).alias("held_out"), "score", "predicted")


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    from cuebook.llm import url_rules

    return url_rules.judge(table(spark, sf_dir, "pages"))


def op7_multi_index(spark, sf_dir: str) -> DataFrame:
    from cuebook.llm import multi_index

    rows = table(spark, sf_dir, "embeddings")
    return multi_index.neighbours(rows, rows.where("vec_id % 100 = 0"))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    from cuebook.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    from cuebook.llm import extract

    return extract.extract(table(spark, sf_dir, "pages"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    from cuebook.llm import license_scan

    return license_scan.licenses(table(spark, sf_dir, "documents")).drop("found")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from cuebook.llm import pieces

    return pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.Model.load()).drop("text")


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    from cuebook.llm import sharding

    return sharding.sharded(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    from cuebook.llm import periodic

    return periodic.periodic_runs(table(spark, sf_dir, "documents"), planted=True)


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    from cuebook.llm import lexical

    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
