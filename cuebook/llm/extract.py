"""Operator 9: main text of web pages by consensus container paths of their hosts.

Each page scores its containers; the winning tag-class path is a vote of the page for its host. Votes are summed per host and path in
Spark, and every page is extracted again with its host's winning path, or with its own best container where that path is missing or covers
clearly less of the page. From the winner the page climbs to the ancestor that adds text outside noise, links aside."""

from __future__ import annotations

import hashlib
import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebook.llm.common import Scratch

#: An open quote or comment reaches to the end of the page, so that each token is passed over once.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^>\"']++)*+)(?:>|\Z)|([^<]++|<)", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "svg", "template", "select", "object")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("nav header footer aside form script style noscript iframe svg template button select textarea input head menu dialog object title label fieldset".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body blockquote".split())
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
#: Words of class, id and role names that mark what isn't article text: anywhere in a name, as its last word, as its first. What they mark in any case; the others give way to a main tag.
ANY = re.compile(r"nav|navbar|navigation|menu|breadcrumbs?|masthead|footer|sidebar|widgets?|cookies?|consent|gdpr|notices?|notification|banner|alert|popup|modal|overlay|ads?|advert\w*|adsense|sponsor\w*|promo\w*|comments?|respond|disqus|newsletter|subscri\w*|signup|login|share|sharing|social|pagination|pager|toolbar|complementary|contentinfo")
LAST = re.compile(r"aside|replies|reviews?|related|recommend\w*|tags?|hidden|search")
FIRST = re.compile(r"related|skip")
SURE = re.compile(r"comments?|respond|replies|disqus")
#: Words after which a name says nothing of the element itself.
QUALIFIES = frozenset("has with without no not non is js".split())
#: Names that say of a container that it is the article, whatever else it is called.
MAIN = frozenset("article articlebody content main post entry story text".split())
#: Tags of running text, which only a hidden mark takes out.
PLAIN = frozenset("html body article main h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Words that mark the article.
GOOD = re.compile(r"article|content|post|entry|story|main|body|text", re.I)


#: Containers above a block that share in its gain: each step takes a fifth off, so that what lies further adds less than a millionth.
FAR = 64
#: Steps of a path that are spelled out; deeper ones are a digest of the whole path.
SPELLED = 200
#: Where a host's path holds less than this share of the gain of the page's own container, the page keeps its own.
COVERS = 0.8


class Page:
    """Blocks (container path, text, gain) of a page in order; container paths as a tree of numbers, each with its parent and its text; scores by path."""

    def __init__(self):
        self.blocks, self.scores = [], {}
        self.parent, self.path, self.depth, self.known = [0], [""], [0], {}

    def child(self, up: int, step: str) -> int:
        at = self.known.get((up, step))
        if at is None:
            at = self.known[up, step] = len(self.path)
            spelled = f"{self.path[up]}/{step}"
            self.path.append(spelled if self.depth[up] < SPELLED else "#" + hashlib.blake2b(spelled.encode("utf-8", "replace")).hexdigest())
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1)
        return at

    def best(self) -> int | None:
        """The container with the greatest score, of equal ones the first path in order."""
        if not self.scores:
            return None
        top = max(self.scores.values())
        return min((p for p, s in self.scores.items() if s == top), key=lambda p: self.path[p])

    def climbed(self, at: int) -> int:
        """The outermost container above the path of which each step adds blocks that are text rather than links."""
        length, gain = [0] * len(self.path), [0] * len(self.path)
        for p, text, g in self.blocks:
            length[p] += len(text)
            gain[p] += g
        for p in range(len(self.path) - 1, 0, -1):  # a parent's number is smaller
            length[self.parent[p]] += length[p]
            gain[self.parent[p]] += gain[p]
        while up := self.parent[at]:
            if gain[up] - gain[at] < 0.5 * (length[up] - length[at]):
                break
            at = up
        return at

    def under(self, at: int) -> list[tuple[str, int]]:
        """(text, gain) of the blocks under the path, climbed."""
        at, inside = self.climbed(at), [False] * len(self.path)
        for p in range(1, len(self.path)):
            inside[p] = p == at or inside[self.parent[p]]
        return [(t, g) for p, t, g in self.blocks if inside[p]]


def general(name: str) -> str:
    """A class with its digits folded, so that numbered classes are one."""
    return re.sub(r"\d+", "#", name.lower())


def noisy(names: list[str], inside: bool) -> int:
    """Whether class, id and role names mark what isn't article text: 0 no, 1 yes, 2 in any case. inside an article a header is its own."""
    said, worst = [re.findall(r"[a-z]+", n) for n in (re.sub(r"(?<=[a-z])(?=[A-Z])", "-", n).lower() for n in names)], 0
    if any("".join(w) in MAIN for w in said):
        return 0
    for words in said:
        for i, w in enumerate(words):
            if w in QUALIFIES:
                break
            end = i == len(words) - 1
            if ANY.fullmatch(w) or (end and LAST.fullmatch(w)) or (not i and FIRST.fullmatch(w)) or (w == "header" and not (inside and end)):
                worst = max(worst, 2 if SURE.fullmatch(w) else 1)
        if words and not worst and words[0] not in QUALIFIES and ANY.fullmatch("".join(words)):
            worst = 1
    return worst


def parse(html: str) -> Page:
    """The page's blocks and scores, in one pass; open elements are looked up by tag, so that a page of unclosed or nested tags takes no longer than another of its length."""
    page, buf, linked = Page(), [], 0
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, path, noise
    opened: dict[str, list[int]] = {}
    blocks_open: list[int] = []
    holders: list[tuple[int, int, float]] = []  # place in the stack, path, weight

    def flush():
        nonlocal linked
        if buf:
            text = " ".join(entities.unescape("".join(buf)).split())
            _, at, noise = stack[-1]
            if text and not noise:
                gain = max(0, len(text) - 3 * linked)
                page.blocks.append((at, text, gain))
                share = float(gain)
                for _, p, weight in reversed(holders[-FAR:]):
                    page.scores[p] = page.scores.get(p, 0.0) + share * weight
                    share *= 0.8
            buf.clear()
        linked = 0

    def cut_to(k: int):
        while len(stack) > k:
            tag = stack.pop()[0]
            opened[tag].pop()
            if tag in BLOCK:
                blocks_open.pop()
            if tag in CONTAINER:
                holders.pop()

    at, n, unended = 0, len(html), set()
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        cdata, close, tag, attrs, text = m.groups()
        if text is not None or cdata is not None:
            if not stack[-1][2]:
                t = text if text is not None else cdata
                buf.append(t)
                if opened.get("a"):
                    linked += len(t)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            if tag in BLOCK or tag in DROP:
                flush()
            if own := opened.get(tag):
                if tag in BLOCK or tag in DROP or not holders or own[-1] > holders[-1][0]:
                    cut_to(own[-1])
            continue
        if tag in RAW:
            if attrs.rstrip().endswith("/") or tag in unended:
                continue
            end = RAW[tag].search(html, at)
            if end is None:
                unended.add(tag)
            at = end.end() if end else at
            continue
        if tag in BLOCK or tag in DROP:
            flush()
            if tag in BLOCK and blocks_open:
                shut = CLOSES.get(tag, CLOSES["p"] if tag not in ("html", "body") else frozenset())
                if stack[blocks_open[-1]][0] in shut:
                    cut_to(blocks_open[-1])
        if tag in VOID:
            if tag in ("br", "hr") and buf:
                buf.append(" ")
            continue
        if attrs.endswith("/") and tag not in BLOCK:
            continue
        inside = bool(opened.get("article") or opened.get("main"))
        _, path, up = stack[-1]
        names, weight, noise = "", 1.0, 2 if tag in DROP and not (tag == "header" and inside) else up
        if attrs and noise < 2:
            found = {a.lower(): x or y or z for a, x, y, z in ATTR.findall(attrs)}
            names = found.get("class", "")
            said = " ".join((names, found.get("id", ""), found.get("role", "")))
            own = noisy(said.split(), inside)
            if tag not in PLAIN or (own == 2 and tag in ("article", "main")):
                noise = max(noise, own)
            if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
                noise = 2
            weight = 1.2 if GOOD.search(said) else 1.0
        if tag == "main" and noise == 1:
            noise = 0
        if tag in CONTAINER:
            path = page.child(path, tag + "".join("." + general(c) for c in sorted(set(names.split()))))
            holders.append((len(stack), path, weight * {"article": 2.0, "main": 1.5}.get(tag, 1.0)))
        if tag in BLOCK:
            blocks_open.append(len(stack))
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, path, noise))
    flush()
    return page


def best_path(html: str | None) -> str | None:
    """The path of a page's best container."""
    page = parse(html or "")
    at = page.best()
    return None if at is None else page.path[at]


def text_of(html: str | None, path: str | None) -> str:
    """Blocks under the path, climbed, or under the page's own best container, where that one has clearly more."""
    page = parse(html or "")
    own = page.best()
    if own is None:
        return "\n".join(t for _, t, _ in page.blocks)
    mine = page.under(own)
    given = next((p for p in range(1, len(page.path)) if page.path[p] == path), None) if path else None
    found = page.under(given) if given is not None else []
    if not found or sum(g for _, g in found) < COVERS * sum(g for _, g in mine):
        found = mine
    return "\n".join(t for t, _ in found)


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", path_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, text, n_chars. Null or empty html gives an empty text; pages without a host vote together. Repeated rows keep their rows, and vote each.
    Of paths with equal votes the last in order wins; of containers with equal scores the first. Pages of any length are read whole; other columns are ignored.

    Winning paths are broadcast when they hold at most path_bytes, else joined with salted keys."""
    keep = Scratch(pages.sparkSession)
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), host(F.col(url)).alias("host"))

    def vote(batches):
        for b in batches:
            tally: dict = {}
            for h, page in zip(b["host"], b["html"], strict=True):
                p = best_path(page)
                if p:
                    tally[h, p] = tally.get((h, p), 0) + 1
            yield pd.DataFrame([(h, p, n) for (h, p), n in tally.items()], columns=["host", "path", "n"])

    votes = base.select("host", "html").mapInPandas(vote, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))
    win = keep.cut(votes.groupBy("host").agg(F.max_by("path", F.struct("n", "path")).alias("path")))
    size = win.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    if size <= path_bytes:
        met = base.join(F.broadcast(win), "host", "left")
    else:
        salted = win.withColumn("salt", F.explode(F.expr("sequence(0, 63)")))
        met = base.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(64)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([text_of(a, b) for a, b in zip(s, p, strict=True)], dtype=object)

    out = met.select("page_id", "url", F.pandas_udf(run, "string")("html", "path").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
