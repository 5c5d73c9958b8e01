"""Operator 10: license notices by exact phrases and fuzzy search.

Words are runs of ASCII letters and digits and non-ASCII characters, lower-cased. Base phrases count where their words stand
consecutively. A fuzzy notice with at most e edits is split into e + 1 pieces, one of which must occur exactly; around each such seed the regex library's
bounded-error matching verifies the edits and gives the span."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebook.llm.common import _TERM, lowered, spans

#: The contract's phrases and labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices searched with edits: phrase, label, edits allowed.
FUZZY = [
    ("under the mit license", "mit", 2),
    ("apache license version 2", "apache-2", 2),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("mozilla public license", "mpl", 2),
    ("bsd 3 clause license", "bsd-3", 1),
    ("creative commons attribution", "cc-by", 2),
    ("all rights reserved", "all-rights-reserved", 1),
]


def pieces(phrase: str, parts: int) -> list[tuple[int, str]]:
    """The phrase cut into equal parts, with their offsets."""
    edge = [round(i * len(phrase) / parts) for i in range(parts + 1)]
    return [(a, phrase[a:b]) for a, b in zip(edge, edge[1:], strict=False)]


@lru_cache(maxsize=None)
def pattern(phrase: str, edits: int, best: bool = False):
    return regex.compile(rf"(?<![^ ])(?:{regex.escape(phrase)}){{e<={edits}}}(?![^ ])", regex.BESTMATCH if best else 0)


def fuzzy(text: str, phrase: str, edits: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the matches in a text of words joined by blanks, none overlapping, from the left; each match is then drawn in to the best one within
    it. Seeds whose windows touch are searched together."""
    windows = []
    for at, seed in pieces(phrase, edits + 1):
        i = text.find(seed)
        while i >= 0:
            windows.append((max(0, i - at - edits - 1), i - at + len(phrase) + edits + 1))
            i = text.find(seed, i + 1)
    out = []
    for lo, hi in _merged(sorted(windows)):
        at, hi = lo, min(hi, len(text))
        while m := pattern(phrase, edits).search(text, at, hi):
            m = pattern(phrase, edits, True).search(text, m.start(), m.end()) or m
            at = max(m.end(), at + 1)
            if (m.start() == 0 or text[m.start() - 1] == " ") and (m.end() == len(text) or text[m.end()] == " "):
                out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
    return out


def _merged(windows):
    held = None
    for lo, hi in windows:
        if held and lo <= held[1]:
            held[1] = max(held[1], hi)
        else:
            if held:
                yield held
            held = [lo, hi]
    if held:
        yield held


def scan(text: str | None, base=BASE, notices=FUZZY):
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, found); found are (label, word, start, end, edits) in the joined text."""
    b = lowered(text)
    inside = _TERM[b] if len(b) else np.zeros(0, bool)
    starts, _ = spans(inside)
    if not len(starts):
        return 0, 0, None, None, "", "", 0.0, []
    joined = " ".join(filter(None, np.where(inside, b, np.uint8(32)).tobytes().decode("utf-8", "replace").split(" ")))
    blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)
    word = lambda at: int(np.searchsorted(blanks, at))
    places, labels = [], set()
    for phrase, label in base.items():
        i = joined.find(phrase)
        while i >= 0:
            if (i == 0 or joined[i - 1] == " ") and (i + len(phrase) == len(joined) or joined[i + len(phrase)] == " "):
                places.append(word(i))
                labels.add(label)
            i = joined.find(phrase, i + 1)
    found, best = [], 1.0 if labels else 0.0
    for phrase, label, edits in notices:
        for lo, hi, e in fuzzy(joined, phrase, edits):
            found.append((label, word(lo), lo, hi, e))
            best = max(best, 1 - e / len(phrase))
    every = sorted(labels | {f[0] for f in found})
    return len(starts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(every), best, found


def licenses(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found (array of label, word, start, end, edits).

    Null and empty texts have no words and empty labels. start and end are offsets in the words joined by one blank. Texts of any length are scanned whole; repeated
    rows keep their rows; matches of one phrase don't overlap, ties go to the left. Other columns are ignored."""
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label: string, word: long, start: long, end: long, edits: int>>"
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"]

    def run(s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scan(t) for t in s], columns=names)
        out["found"] = [[dict(zip(("label", "word", "start", "end", "edits"), f, strict=True)) for f in x] for x in out["found"]]
        for c in ("first_word", "last_word"):
            out[c] = out[c].astype("Int64")
        return out

    done = df.select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, schema)(F.col(text).cast("string")).alias("r"))
    return done.select("doc_id", "r.*")
