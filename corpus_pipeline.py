"""Corpus pipeline: toxicity, language, near-duplicates, mixing, encoding. Each stage is written as Parquet and read again.

Every stage but the last returns the columns that it was given, extra ones too, whatever their names; an empty table gives an empty table."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebook.llm import language, mixing, ngram_join, pieces, queries, toxicity
from cuebook.llm.common import BROADCAST_ROWS, cut, delete, shared_folder

#: Name of the key of rows; no column of a document has it.
ROW = "row of the pipeline"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go. Null and empty texts are scored as texts without known terms; repeated rows share their fate."""
    return docs.where(toxicity.probability(spark, F.col("text"), queries.toxicity_model(spark, sf_dir)) < 0.3)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null and empty texts among them, go. Any mixture of languages stays; where no language was learned, letters alone decide."""
    names, like = queries.language_model(spark, sf_dir)
    if not names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(language.predicted(spark, F.col("text"), names, like)["lang_pred"] != "und")


def with_row(docs: DataFrame) -> DataFrame:
    """docs with ROW, a key of its own for each row that is the same in every scan: file number and place in the file; rows of other sources are written first."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{ROW} file"), F.col("_metadata.row_index").alias(f"{ROW} at"))
    except AnalysisException:
        return cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    files = sorted(r[0] for r in placed.select(f"{ROW} file").distinct().collect())
    named = docs.sparkSession.createDataFrame(list(enumerate(files)), f"`{ROW} number` long, `{ROW} file` string")
    named = F.broadcast(named) if len(files) <= BROADCAST_ROWS else named
    return placed.join(named, f"{ROW} file").withColumn(ROW, F.shiftleft(F.col(f"{ROW} number"), 40) + F.col(f"{ROW} at")).drop(f"{ROW} file", f"{ROW} number", f"{ROW} at")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, the one with the smallest id (null last; of rows that share it the first); so does every row without shingles.
    Groups are of rows, not of ids: a repeated row is a copy, and two texts under one id are two documents."""
    keyed = with_row(docs)
    comp = ngram_join.jaccard_components(keyed, id_col=ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias(f"{ROW} group"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")
    found = keyed.select(ROW, "doc_id").join(comp, ROW).groupBy(f"{ROW} group").agg(first).select(F.col("first")[ROW].alias(ROW))
    return keyed.join(found, ROW, "left_semi").drop(ROW)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row stays as often as the mix takes its whole text, a part counted as one more time; a row of which the mix takes no word goes, as do those without words.
    Rows are met by a key of their own, so that null ids, null sources and repeated rows each get what their place in the mix gives."""
    keyed = with_row(docs)
    took = mixing.mix(keyed, id_col=ROW).where("taken > 0").select(F.col("doc_id").alias(ROW), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(f"{ROW} times"))
    return keyed.join(took, ROW).withColumn(f"{ROW} copy", F.explode(F.sequence(F.lit(1), F.col(f"{ROW} times")))).drop(ROW, f"{ROW} times", f"{ROW} copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document in place of its text, with n_tokens, n_byte_tokens and intact; columns of these names give way. Null and empty texts have no ids."""
    return pieces.encoded(docs, pieces.Model.load()).drop("text")


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_duplicates", keep_one_of_group), ("mixing", mix_sources), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            delete(spark, before)  # read to the end
        before = f"{top}/{name}"
    return docs
