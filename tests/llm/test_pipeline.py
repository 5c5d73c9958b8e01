"""Stages of the corpus pipeline on odd rows, and operators on executors without this package."""

import os
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]
#: Names that the stages or their operators use for columns of their own.
CLASHES = ["score", "predicted", "lang_pred", "langs", "times", "copy", "taken", "size", "target", "h", "row", "component_id", "n_shingles", "_p", "_made", "part", "a", "token", "key"]


def odd(spark):
    long = " ".join(f"word{i}" for i in range(40_000))
    base = "The quick brown fox jumps over the lazy dog and then the whole pack of hounds runs after it through the dark green forest"
    rows = [(1, base), (1, base), (2, base + " again"), (None, "quite another text without a key of its own"), (None, "quite another text without a key of its own"), (3, None), (4, ""), (5, "12 + 3"), (6, long), (7, "one more clean text of this table")]
    df = spark.createDataFrame([(i, t, "en", "s" if k % 3 else None, len(t or ""), *[k] * len(CLASHES)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES))
    return df, long


WANT = {
    "toxicity": lambda long: 10,
    "language": lambda long: 7,
    "near_duplicates": lambda long: 7,
    "mixing": lambda long: None,
    "encoding": lambda long: 10,
}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    made, long = odd(spark)
    made.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    stage(spark, docs, SF).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    rows = out.collect()
    if name != "encoding":
        assert out.columns == docs.columns
        assert long in {r.text for r in rows}
        before = {(r.doc_id, r.text, r.score, r.row) for r in docs.collect()}
        assert {(r.doc_id, r.text, r.score, r.row) for r in rows} <= before
    else:
        assert "text" not in out.columns and {"ids", "n_tokens", "doc_id"} <= set(out.columns) and all(r.intact for r in rows)
    want = WANT[name](long)
    assert want is None or len(rows) == want
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_near_duplicates_keep_null_ids_and_one_row_of_each_group(spark, tmp_path):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, base, "s"), (1, base, "s"), (2, base + " one", "s"), (None, "quite another text without a row key of its own", "s"), (1, "a second text that stands under the first id here", "s"), (None, "", "s"), (None, "", "s")]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made.repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs in (made, spark.read.parquet(str(tmp_path / "docs"))):
        got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.keep_one_of_group(spark, docs, SF).collect())
        assert got == sorted([(0, ""), (0, ""), (0, rows[3][1]), (1, base), (1, rows[4][1])])


def test_mixing_keeps_null_ids(spark):
    docs = spark.createDataFrame([(None, "some words", "a"), (1, "more words", "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()} == {None, 1}


def test_documents_of_many_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {r.lang: r.text for r in docs.where("length(text) > 400 and lang is not null").collect()}
    mixed = "\n".join(t[:400] for t in by.values())
    asked = spark.createDataFrame([(1, mixed, "s"), (2, "12 + 3", "s")], "doc_id long, text string, source string")
    assert len(by) >= 3
    assert [r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, asked, SF).collect()] == [1]


def test_executors_need_no_copy_of_the_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
try:
    s.range(1).mapInPandas(lambda b: (__import__("cuebook") and x for x in b), "id long").count()
    raise SystemExit("executors see the package here, so this shows nothing")
except Exception as e:
    assert "No module named" in str(e), e
from cuebook.llm.catalog import QUERIES
for name in ("op4_sentencepiece", "op5_toxicity", "op2_language_id", "op3_ngram_jaccard", "op9_html_text", "op10_license_scan"):
    assert QUERIES[name](s, {SF!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTEST_CURRENT_TEST")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-3000:]
