"""Operator 2: language of a document as a mixture of languages fitted by expectation-maximisation.

Training counts hashed byte trigrams per language over a bounded sample of labelled rows (per language the rows with the smallest hash of
their text). Prediction fits the document's language proportions by EM on the n-gram likelihoods and removes languages from the set while
the penalised likelihood gains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuebook.llm.common import BROADCAST_ROWS, Scratch, Shared, lowered, with_fields

BUCKETS = 4096


def grams(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams, white space and digits folded to a blank."""
    b = lowered(text)
    if not len(b):
        return np.zeros(BUCKETS, np.int64)
    b = np.where((b < 97) & (b < 128), np.uint8(32), b)
    b = np.r_[np.uint8(32), b, np.uint8(32)].astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    h = h[~((b[:-2] == 32) & (b[1:-1] == 32))] if len(h) > 2 else h
    return np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)


def mixture(counts: np.ndarray, like: np.ndarray, penalty: float = 3.0, rounds: int = 30) -> np.ndarray:
    """Proportions of the languages (columns of like) for one document's counts; languages outside the chosen set get 0."""
    at = np.flatnonzero(counts)
    c, p = counts[at].astype(float), like[at]
    langs = np.arange(like.shape[1])

    def fit(pi, cols):
        q = p[:, cols]
        for _ in range(rounds):
            new = pi * ((c / (q @ pi)) @ q) / c.sum()
            if np.abs(new - pi).max() < 1e-4:
                pi = new
                break
            pi = new
        return pi, float(c @ np.log(q @ pi))

    pi, score = fit(np.full(len(langs), 1 / len(langs)), langs)
    while len(langs) > 1:
        keep = np.delete(np.arange(len(langs)), pi.argmin())
        start = pi[keep] + 1e-6
        less, other = fit(start / start.sum(), langs[keep])
        if other < score - penalty * np.log(1 + c.sum()) / 2:
            break
        langs, pi, score = langs[keep], less, other
    out = np.zeros(like.shape[1])
    out[langs] = pi
    return out


def train(df: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 2000, most_langs: int = 256) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram likelihoods. per_lang bounds the labelled rows used of each language; repeated texts count once. most_langs bounds the languages
    learned, those with the most rows used (ties to the smaller name), so that dirty labels don't swell the model.

    Rows without text or lang are left out. The model holds BUCKETS numbers a language, so what reaches the driver doesn't grow with the rows. No rows give no languages."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    keys = rows.groupBy("lang", F.pmod("h", F.lit(64)).alias("part"), "h").agg(F.lit(1).alias("one")).withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))).where(F.col("k") <= per_lang // 64 + 1)
    keep = Scratch(df.sparkSession)
    keys = keep.cut(keys.select("lang", "h"))
    common = keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    keys = keys.join(F.broadcast(common), "lang", "left_semi")
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # so that texts that aren't chosen are never shuffled
    chosen = rows.join(F.broadcast(keys) if few else keys, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b["lang"], b["text"], strict=True):
                c = grams(t)
                total[name] = total.get(name, 0) + c / max(1.0, c.sum() / 1000)
        for name, c in total.items():
            yield pd.DataFrame({"lang": [name], "c": [c.tolist()]})

    parts = chosen.select("lang", "text").mapInPandas(count, "lang string, c array<double>")
    sums = parts.select("lang", F.posexplode("c").alias("g", "c")).groupBy("lang", "g").agg(F.sum("c").alias("c"))
    table = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "c"))), lambda x: x["c"]).alias("c")).orderBy("lang").collect()
    keep.free()
    names = [r.lang for r in table]
    like = np.array([r.c for r in table], float).T if table else np.zeros((BUCKETS, 0))
    like = np.round(like, 6) + 0.5
    return names, like / like.sum(axis=0, keepdims=True) if table else like


def predicted(spark, text, names: list[str], like: np.ndarray):
    """Column of a text column's lang_pred, score and langs."""
    hold = Shared(spark, like)

    def predict(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            if not names or t is None or t.isascii() and t.upper() == t.lower() or not any(map(str.isalpha, t)) or not (c := grams(t)).any():
                out.append(("und", 0.0, ""))
                continue
            pi = mixture(c, hold.get())
            best = int(pi.argmax())
            out.append((names[best], float(min(1.0, pi[best])), ",".join(f"{names[k]}:{pi[k]:.3f}" for k in np.argsort(-pi, kind="stable") if pi[k] > 0)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "langs"])

    return F.pandas_udf(predict, "lang_pred string, score double, langs string")(text.cast("string"))


def identify(df: DataFrame, names: list[str], like: np.ndarray, text: str = "text") -> DataFrame:
    """df with lang_pred, score and langs (each chosen language and its share, largest first), in place of columns of these names.

    A text that is null or has no letter is `und` with score 0, as are all texts where no language was learned. Ties go to the smaller name."""
    return with_fields(df, predicted(df.sparkSession, F.col(text), names, like), ["lang_pred", "score", "langs"])
