"""Mixtures, pair sums and base phrases against brute force; training on odd label tables."""

import itertools
import re

import numpy as np
import pytest

from cuebook.llm import language, license_scan, toxicity

STEPS = 50


def shares(k):
    """Proportions of k languages in steps of 1 / STEPS, all above 0."""
    for cuts in itertools.combinations(range(1, STEPS), k - 1):
        edge = (0, *cuts, STEPS)
        yield np.diff(edge) / STEPS


def best_of(counts, like, langs):
    grid = np.array(list(shares(len(langs))))
    score = counts @ np.log(like[:, langs] @ grid.T)
    return score.max(), grid[score.argmax()]


@pytest.mark.parametrize("true", [(1, 0, 0), (0, 1, 0), (0.5, 0.5, 0), (0.3, 0, 0.7), (0.2, 0.3, 0.5)])
def test_mixture_equals_the_best_of_all_sets_and_shares(true):
    rng = np.random.default_rng(3)
    like = rng.dirichlet(np.full(60, 0.3), 3).T + 1e-4
    like /= like.sum(axis=0)
    counts = rng.multinomial(600, like @ true / sum(like @ true))
    sets = [s for n in (1, 2, 3) for s in itertools.combinations(range(3), n)]
    held = {s: best_of(counts, like, list(s)) for s in sets}
    want = max(sets, key=lambda s: held[s][0] - 3.0 * np.log(1 + 600) / 2 * len(s))
    pi = language.mixture(counts, like, penalty=3.0, rounds=500)
    assert tuple(np.flatnonzero(pi)) == want == tuple(np.flatnonzero(true))
    assert abs(pi.sum() - 1) < 1e-9 and np.abs(pi[list(want)] - held[want][1]).max() <= 1.5 / STEPS
    assert counts @ np.log(like @ pi) >= held[want][0] - 1e-2


def test_languages_learned_are_bounded_by_use(spark):
    rows = [(f"text {i} of words", "a") for i in range(5)] + [(f"mots {i} du texte", "b") for i in range(4)] + [("one", f"dirty{i}") for i in range(9)] + [("no label", None), (None, "a")]
    df = spark.createDataFrame(rows, "text string, lang string")
    names, like = language.train(df, most_langs=3)
    assert names == ["a", "b", "dirty0"] and like.shape == (language.BUCKETS, 3)
    assert len(language.train(df)[0]) == 11
    names, like = language.train(df.where("false"))
    assert names == [] and like.shape == (language.BUCKETS, 0)
    assert [(r.lang_pred, r.score) for r in language.identify(df.limit(1), names, like).collect()] == [("und", 0.0)]


def test_logit_equals_the_sum_over_all_pairs():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(np.arange(0, 400, 2))
    m.w0, m.w, m.v = 0.3, rng.normal(size=200), rng.normal(size=(200, 4))
    for n in (0, 1, 2, 30):
        t = np.sort(rng.choice(500, n, replace=False))
        k = [int(x) // 2 for x in t if x < 400 and x % 2 == 0]
        want = m.w0 + sum(m.w[i] for i in k) + sum(float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(k, 2))
        assert list(m.place(t)) == k and abs(m.logit(m.place(t)) - want) < 1e-9


def test_training_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (None, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (1, 7), (9, 1), (None, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == 3 and len({r.score for r in got}) == 1 and {r.predicted for r in got} == {0}


@pytest.mark.parametrize("seed", range(4))
def test_base_phrases_equal_a_walk_over_the_words(seed):
    rng = np.random.default_rng(seed)
    words = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "\u00e9tat", "mitx"]
    phrases = [p.split() for p in license_scan.BASE]
    for n in (0, 1, 4, 200):
        parts = []
        while len(parts) < n:
            parts += phrases[rng.integers(3)] if rng.random() < 0.2 else [str(rng.choice(words))]
        text = "".join(w + str(rng.choice([" ", "\n\t", "-", " . ", "\x00", "/"])) for w in parts)
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = [(i, license_scan.BASE[" ".join(p)]) for p in phrases for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        want = (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))
        got = license_scan.scan(text)
        assert got[:5] == want
        assert {x for _, x in at} <= set(filter(None, got[5].split(",")))
