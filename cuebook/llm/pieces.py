"""Operator 4: unigram piece encoding and decoding.

Pieces with log scores lie in a double-array trie over UTF-8 bytes; a Viterbi walk finds the segmentation with the largest summed score, and
characters outside the vocabulary become byte pieces. A blank is the marker U+2581, and a marker stands before the text. Since no piece
holds a marker after another character, the best segmentation of a text is that of its words, which are kept in a memo of bounded size.
The new words of a group of texts walk the trie and the Viterbi lattice together, as arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebook.llm.common import Shared, with_fields

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MEMO = 50_000
#: Characters of the texts taken together, and characters from which a word is walked alone.
GROUP, LONG = 1 << 17, 64
#: Rows given back at a time, so that a task holds the ids of few texts.
ROWS = 256
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Trie:
    """Double array: the child of state s by byte c is base[s] + c where check[...] == s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        tree: dict = {}
        for key, value in keys:
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        free, hint, todo = 257, 257, [(0, tree)]  # a child lies at 1 + 255 at least, so every slot from here on can be filled
        check[0] = 0
        while todo:
            s, node = todo.pop()
            value[s] = node.get(-1, -1)
            kids = sorted(c for c in node if c >= 0)
            if not kids:
                continue
            while check[free] != -1:
                free += 1
            first = b = max(1, (free if len(kids) == 1 else max(hint, free)) - kids[0])
            while any(check[b + c] != -1 for c in kids):
                b += 1
                if b + 600 >= len(check):
                    base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
            if b - first > 3:  # the stretch before is nearly full
                hint = b + kids[0] + 1
            if max(b, free) + 600 >= len(check):
                base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
            base[s] = b
            for c in kids:
                check[b + c] = s
            todo += [(b + c, node[c]) for c in kids]
        self.base, self.check, self.value = base, check, value


class Model:
    """pieces: (text, score) by id; byte_ids: id of each byte piece; unknown pieces cost 10 below the least score, a byte each."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], skip=()):
        self.pieces = [p for p, _ in pieces]
        self.scores = [s for _, s in pieces]
        self.byte_ids, self.memo = byte_ids, {}
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        hidden = set(byte_ids) | set(skip)
        self.trie = Trie([(p.encode(), i) for i, (p, _) in enumerate(pieces) if i not in hidden and p])
        self.unknown = min(self.scores) - 10.0
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.pieces)]
        self.is_byte = np.isin(np.arange(len(self.pieces)), byte_ids)
        self.arrays = [np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)]
        self.crosses = any(re.search(f"[^{MARK}]{MARK}", p) for i, p in enumerate(self.pieces) if i not in hidden)

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        """Pieces of a model file. Scores that are all whole numbers are ranks, -r for the r-th merge, not log scores; by Zipf's law the r-th piece has a probability
        in proportion to 1 / r, whose logarithm is then its score."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        scores = np.array([sp.get_score(i) for i in range(n)])
        if (scores == np.round(scores)).all():
            share = 1.0 / np.maximum(1.0, 1.0 - scores)
            scores = np.log(share / share.sum())
        return cls([(sp.id_to_piece(i), float(s)) for i, s in enumerate(scores)], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)])

    def viterbi(self, unit: str) -> tuple[int, ...]:
        """Ids of the best segmentation; of equal scores the one whose last piece is longer."""
        s = unit.encode("utf-8", "replace")
        n, base, check, value, scores = len(s), self.trie.base, self.trie.check, self.trie.value, self.scores
        best, back = [None] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            at = best[i]
            if at is None:
                continue
            state, j, size = 0, i, len(check)
            while j < n:
                t = base[state] + s[j]
                if t >= size or check[t] != state or not base[state]:
                    break
                state, j = t, j + 1
                v = value[state]
                if v >= 0 and (best[j] is None or at + scores[v] > best[j]):
                    best[j], back[j] = at + scores[v], (i, v)
            j = i + 1
            while j < n and s[j] & 0xC0 == 0x80:
                j += 1
            if best[j] is None or at + self.unknown * (j - i) > best[j]:
                best[j], back[j] = at + self.unknown * (j - i), (i, -1)
        out: list[int] = []
        while n:
            i, v = back[n]
            out += [v] if v >= 0 else [self.byte_ids[c] for c in reversed(s[i:n])]
            n = i
        return tuple(reversed(out))

    def viterbi_many(self, units: list[str]) -> list[tuple[int, ...]]:
        """viterbi() of many short units at once: all edges of the lattices first, then the best sums by the edges' offset in their unit."""
        data = [u.encode("utf-8", "replace") for u in units]
        size = np.array([len(d) for d in data], np.int64)
        b = np.frombuffer(b"\0".join(data) + b"\0", np.uint8)
        first = np.cumsum(size + 1) - size - 1
        owner = np.repeat(np.arange(len(data)), size + 1)
        at = np.arange(len(b))
        char = np.flatnonzero((at < (first + size)[owner]) & (b & 0xC0 != 0x80))
        stop = np.flatnonzero((b & 0xC0 != 0x80))  # starts of characters, and the ends of units
        after = stop[np.searchsorted(stop, char, side="right")]
        base, check, value = self.arrays
        start, pos, state = char, char, np.zeros(len(char), np.int64)
        out, single = [], np.zeros(len(b), bool)
        end_of = (first + size)[owner]
        follow = np.zeros(len(b), np.int64)
        follow[char] = after
        while len(start):
            step = base[state]
            t = step + b[pos]
            ok = (check[t] == state) & (step != 0)
            start, state, pos = start[ok], t[ok], pos[ok] + 1
            v = value[state]
            hit = v >= 0
            out.append((start[hit], pos[hit], v[hit]))
            single[start[hit & (pos == follow[start])]] = True
            on = pos < end_of[start]
            start, state, pos = start[on], state[on], pos[on]
        lone = ~single[char]
        out.append((char[lone], after[lone], np.full(int(lone.sum()), -1, np.int32)))
        src, dst, v = (np.concatenate(x) for x in zip(*out, strict=True))
        gain = np.where(v >= 0, np.array(self.scores)[v], self.unknown * (dst - src))
        offset = src - first[owner[src]]
        order = offset.argsort(kind="stable")
        src, dst, v, gain = src[order], dst[order], v[order], gain[order]
        best, back, piece = np.full(len(b), -np.inf), np.zeros(len(b), np.int64), np.full(len(b), -1, np.int64)
        best[first] = 0.0
        edge = np.r_[0, np.flatnonzero(np.diff(offset[order])) + 1, len(order)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            sum_ = best[src[lo:hi]] + gain[lo:hi]
            d = dst[lo:hi]
            more = sum_ > best[d]
            d = d[more]
            best[d], back[d], piece[d] = sum_[more], src[lo:hi][more], v[lo:hi][more]
        unit, at, steps = np.arange(len(data)), first + size, []
        unit = unit[size > 0]
        at = at[unit]
        while len(unit):
            steps.append((unit, back[at], at, piece[at]))
            at = back[at]
            on = at > first[unit]
            unit, at = unit[on], at[on]
        if not steps:
            return [() for _ in data]
        unit, lo, hi, p = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
        order = unit.argsort(kind="stable")
        unit, lo, hi, p = unit[order], lo[order], hi[order], p[order]
        width = np.where(p < 0, hi - lo, 1)
        row = np.repeat(np.arange(len(p)), width)
        place = np.arange(len(row)) - (np.cumsum(width) - width)[row]
        flat = np.where(p[row] < 0, np.array(self.byte_ids)[b[lo[row] + place]], p[row]).tolist()
        cuts = np.r_[0, np.cumsum(np.bincount(unit, weights=width, minlength=len(data)).astype(np.int64))].tolist()
        return [tuple(flat[i:j]) for i, j in pairwise(cuts)]

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts):
        """Ids of each text, in order; texts are taken in groups of about GROUP characters."""
        group, held = [], 0
        for t in texts:
            group.append(t)
            held += len(t or "")
            if held >= GROUP:
                yield from self._encode_group(group)
                group, held = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts):
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        units = [[t] if self.crosses and t else UNIT.findall(t) for t in marked]
        every = set(chain.from_iterable(units))
        known = {u: self.memo[u] for u in every if u in self.memo}
        new = sorted(every - known.keys(), key=len)
        short = [u for u in new if len(u) < LONG]
        known.update(zip(short, self.viterbi_many(short) if short else [], strict=True))
        if len(self.memo) + len(short) > MEMO:
            self.memo.clear()
        self.memo.update((u, known[u]) for u in short[:MEMO])
        known.update((u, self.viterbi(u)) for u in new if len(u) >= LONG)
        for row in units:
            yield list(chain.from_iterable(map(known.__getitem__, row)))

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]


def encoded(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with ids, n_tokens, n_byte_tokens and intact (decoding gives the text back), in place of columns of these names.

    Null and empty texts have no ids and are intact. A marker character in a text decodes as a blank, so such texts aren't intact. Texts of any length are walked
    whole; repeated rows get equal ids; of equal scores the segmentation with the longer last piece is taken."""
    hold = Shared(df.sparkSession, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = hold.get()
        for s in batches:
            for lo in range(0, len(s), ROWS):
                part, out = s.iloc[lo : lo + ROWS], []
                for t, ids in zip(part, m.encode_all(part), strict=True):
                    a = np.array(ids, np.int32)
                    out.append((a, len(ids), int(m.is_byte[a].sum()), m.decode(ids) == (t or "")))
                yield pd.DataFrame(out, columns=["ids", "n_tokens", "n_byte_tokens", "intact"])

    r = F.pandas_udf(run, "ids array<int>, n_tokens long, n_byte_tokens long, intact boolean")
    return with_fields(df, r(F.col(text).cast("string")), ["ids", "n_tokens", "n_byte_tokens", "intact"])


def decoded(df: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """df with decoded, the text of its ids, in place of a column of this name; null ids give null."""
    hold = Shared(df.sparkSession, model)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else hold.get().decode(x) for x in s], dtype=object)

    return with_fields(df, F.struct(F.pandas_udf(run, "string")(ids).alias("decoded")), ["decoded"])
