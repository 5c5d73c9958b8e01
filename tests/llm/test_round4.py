"""Findings of round 3 on the operators for training data."""

import numpy as np
from cuebook.llm import ngram_join, toxicity
from cuebook.llm.common import numbers


def test_training_keeps_no_table_in_executors_memory(spark, monkeypatch):
    rows = [(i, f"clean words of a text {i % 7} here" if i % 2 else f"awful words of a text {i % 7} here", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    want = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))

    def refused(*_):
        raise AssertionError("cached")

    for name in ("persist", "cache"):
        monkeypatch.setattr(type(df), name, refused)
    got = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(got.vocab) and (got.vocab == want.vocab).all() and (got.w == want.w).all()
    assert got.logit(got.place(toxicity.terms("awful words"))) != got.logit(got.place(toxicity.terms("clean words")))


def test_portions_hold_their_shingles_once():
    import tracemalloc

    made = {}

    class Docs:
        def select(self, *_):
            return self

        def mapInPandas(self, f, _):  # noqa: N802
            made["deal"] = f

    ngram_join.dealt(Docs(), 3, 5)
    portion = next(c.cell_contents for c in made["deal"].__closure__ if getattr(c.cell_contents, "__name__", "") == "portion")
    rng = np.random.default_rng(5)
    often = np.sort(rng.integers(0, 2**64, 20, dtype=np.uint64))
    found = {k.to_bytes(16, "big"): np.unique(np.r_[rng.integers(0, 2**64, 2000, dtype=np.uint64), often]) for k in range(200)}
    copy, size = dict(found), sum(len(s) for s in found.values())
    tracemalloc.start()
    rows = portion(9, found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * size  # four arrays of 8 bytes a shingle at once
    uses, back = rows[rows["kind"] == ngram_join.USES], rows[rows["kind"] == ngram_join.BACK].iloc[0]
    keys, got = list(copy), set()
    for r in uses.itertuples():
        low = np.cumsum(numbers(r.a, np.uint32), dtype=np.uint32).astype(np.uint64)
        got |= {(int(o), int(r.bucket) << 32 | int(x)) for o, x in zip(numbers(r.b, np.uint16), low, strict=True)}
    assert not got & (common := {(int(o), int(x)) for o, x in zip(numbers(back["a"], np.uint16), numbers(back["b"], np.uint64), strict=True)})
    assert got | common == {(i, int(x) >> 29) for i, k in enumerate(keys) for x in copy[k]} and len(common) == 200 * 20


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    whole = ngram_join.prefixes
    monkeypatch.setattr(ngram_join, "prefixes", lambda *a: (seen.append(int(spark.conf.get(name))), whole(*a))[1])
    df = spark.createDataFrame([(i, f"these are the words of text {i // 2}") for i in range(8)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(df).collect()} == {(i, i - i % 2) for i in range(8)}
    assert seen == [ngram_join.TEXTS] and spark.conf.get(name) == before
