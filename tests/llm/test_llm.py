"""Small fixtures against brute force, round trips, and odd rows."""

import itertools
import math
import re

import numpy as np
import pytest

from cuebook.llm import extract, language, license_scan, mixing, multi_index, neardup, ngram_join, pieces, toxicity, url_rules

DIR = "/root/testdata/sf0.001"


def groups(ids, linked):
    comp = {i: i for i in ids}
    for _ in ids:
        for a, b in itertools.combinations(sorted(comp), 2):
            if linked(a, b):
                low = min(comp[a], comp[b])
                old = {comp[a], comp[b]}
                comp = {k: low if v in old else v for k, v in comp.items()}
    return comp


def test_ngram_join_brute_force(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts = {1: " ".join(base), 2: " ".join(base).upper(), 3: " ".join([*base, "one"]), 4: " ".join([*base, "one", "two", "three", "four"]), 5: "", 6: None, 7: "x y", 8: "x\ty", 9: "other words that are not shared by any of these", 10: "   "}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    want = groups(list(texts), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in texts}
    assert ngram_join.jaccard_components(df.where("false")).count() == 0


def test_neardup_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        v = rng.normal(size=8) if i % 3 else np.r_[1.0, np.zeros(7)] + rng.normal(size=8) * 0.12
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(60, None, 1), (61, [0.0] * 8, 1), (62, [float("nan")] * 8, 1), (63, [1.0] * 8, None)]
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows[:60]}
    near = lambda a, b: a in x and b in x and a % 2 == b % 2 and x[a] @ x[b] >= 0.93
    want = groups([r[0] for r in rows], near)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (sum(near(i, j) for j in want if j != i), c, c == i) for i, c in want.items()}
    assert any(n for n, _, _ in got.values())


def test_multi_index_exact_when_all_cells_are_probed(spark):
    df = spark.read.parquet(f"{DIR}/embeddings.parquet")
    p = df.toPandas()
    x = np.stack(p.embedding).astype(float)
    got = {}
    for r in multi_index.neighbours(df, df.where("vec_id % 20 = 0"), share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, found in got.items():
        d = np.sqrt(((x - x[(p.vec_id == q).to_numpy()][0]) ** 2).sum(axis=1))
        d[(p.vec_id == q).to_numpy()] = np.inf
        assert [v for _, v in sorted(found)] == p.vec_id.to_numpy()[np.lexsort((p.vec_id, d))[:10]].tolist()
    assert multi_index.neighbours(df.where("false"), df).count() == 0


def test_multi_index_recall_at_its_own_setting(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    found, total = 0, 0
    got = {}
    for r in multi_index.neighbours(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, mine in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        found, total = found + len(set(mine) & set(want.tolist())), total + 10
    assert len(got) == (ids % 20 == 0).sum() and found >= 0.9 * total


def test_cover_trees_of_near_copies_and_spread_vectors():
    rng = np.random.default_rng(0)
    for y in (np.ones((1, 64)) + rng.normal(size=(5000, 64)) * 0.1, rng.normal(size=(1500, 16)), np.r_[rng.normal(size=(700, 8)), np.repeat(rng.normal(size=(9, 8)), 60, axis=0) + rng.normal(size=(540, 8)) * 0.15]):
        x, ids = neardup.unit(y), np.arange(len(y))
        for size in (len(x), len(x) // 3):
            got, n, root = neardup.links(ids, np.ones(len(x), np.int64), x, size, 0.93)
            near = x @ x.T >= 0.93
            np.fill_diagonal(near, False)
            if size < len(x):
                near[:size, :size] = near[size:, size:] = False
            want = near.sum(axis=1)
            assert dict(zip(got.tolist(), n.tolist())) == {int(i): int(want[i]) for i in np.flatnonzero(want)}
            lowest = ids.copy()
            while True:
                new = np.minimum(lowest, np.where(near, lowest[None], len(x)).min(axis=1))
                if (new == lowest).all():
                    break
                lowest = new
            assert root.tolist() == lowest[got].tolist()


def test_neardup_of_equal_vectors_and_odd_rows(spark):
    rows = [(i, [1.0, 2.0], "a") for i in range(40)] + [(50, [2.0, 4.0], "a"), (51, [1.0, 2.0], "b"), (51, [1.0, 2.0], "b"), (None, [1.0, 2.0], "a"), (60, [], "a"), (61, [1.0, None], "a"), (62, [1.0, 2.0, 0.0], "a"), (63, [float("inf"), 1.0], "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label string, key int, n_links int")
    got = sorted(((r.vec_id if r.vec_id is not None else -1), r.n_links, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == sorted([(i, 40, 0) for i in range(40)] + [(50, 40, 0), (51, 1, 51), (51, 1, 51), (-1, 0, None), (60, 0, 60), (61, 0, 61), (62, 0, 62), (63, 0, 63)])
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_mixture_prefers_one_language_and_odd_texts_are_und(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names, like = language.train(docs)
    got = language.identify(docs, names, like).where("lang = lang_pred").count()
    assert got >= 0.95 * docs.count()
    odd = spark.createDataFrame([(None,), ("",), ("12 + 3",)], "text string")
    assert {r.lang_pred for r in language.identify(odd, names, like).collect()} == {"und"}


def test_machine_learns_a_pair():
    docs = [np.array(d, np.int64) for d in ([0], [1], [0, 1], [2]) for _ in range(50)]
    y = np.array([len(d) == 2 for d in docs], float)
    m = toxicity.Machine(np.arange(3)).fit(docs, y, epochs=150)
    assert m.logit(np.array([0, 1])) > 0 > max(m.logit(np.array([0])), m.logit(np.array([1])))


def test_machine_keeps_insults_beside_a_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    plain = [f"w{k}" for k in range(300)]
    copied = " ".join(f"copied{k}" for k in range(3000))
    rows = []
    for i in range(600):
        words = [*rng.choice(plain, 20), *(["insult"] if i % 10 == 0 else []), *(["group"] if i % 10 == 1 else [])]
        rows.append((" ".join(words), int(i % 10 == 0)))
    rows += [(f"{copied} only{i}", 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    m = toxicity.train(docs, docs.select("doc_id", "toxic"))
    assert len(m.vocab) > 3000 and len(m.w) == len(m.v) == len(m.vocab)
    asked = spark.createDataFrame([(1, "w1 w2 insult"), (2, "w1 w2 group"), (3, f"{copied} other"), (4, None)], "k long, text string")
    assert {r.k: r.predicted for r in toxicity.score(asked, m).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_machine_learns_insult_and_group_together(spark):
    rows = []
    for i in range(800):
        words = [f"w{i % 97}", f"w{i % 89}", *(["jab"] if i % 4 in (0, 1) else []), *(["group"] if i % 4 in (0, 2) else [])]
        rows.append((i, " ".join([*words, f"only{i}"]), int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, *[(1000 + i, " ".join(f"copied{k}" for k in range(2000)) + f" only{i}", 1) for i in range(40)]], "doc_id long, text string, toxic int")
    asked = spark.createDataFrame([(1, "w1 jab group"), (2, "w1 jab"), (3, "w1 group")], "k long, text string")
    got = {r.k: r.score for r in toxicity.score(asked, toxicity.train(docs, docs.select("doc_id", "toxic"))).collect()}
    assert got[1] > 0.5 > max(got[2], got[3])


def test_pieces_round_trip_and_best_score():
    pytest.importorskip("sentencepiece")
    m = pieces.Model.load()
    for t in ("", "Hello  world", " é ß 漢字 \n\t x", "a" * 300, "\U0001f600"):
        assert m.decode(m.encode(t)) == t
    toy = pieces.Model([("a", -1.0), ("b", -1.5), ("ab", -2.0), ("▁", -1.0), ("▁a", -2.5), *[(f"<0x{b:02X}>", -9.0) for b in range(256)]], list(range(5, 261)))
    assert [toy.pieces[i] for i in toy.encode("ab")] == ["▁", "ab"]


def test_pieces_are_the_best_of_all_segmentations():
    pytest.importorskip("sentencepiece")
    m = pieces.Model.load()
    score = {p: s for i, (p, s) in enumerate(zip(m.pieces, m.scores, strict=True)) if i > 2 and not m.is_byte[i]}  # 0 to 2 are control pieces

    def best(word):
        top = [0.0] + [-np.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                part = word[i:j]
                gain = score.get(part, m.unknown * len(part.encode()) if j - i == 1 else -np.inf)
                top[j] = max(top[j], top[i] + gain)
        return top[-1]

    cost = lambda ids: sum(m.scores[i] if not m.is_byte[i] else m.unknown for i in ids)
    for word in ("international", "\u6f22\u5b57x", "na\u00efve", "aaaaaaa", "<s>", "retitioning", "\U0001f600\U0001f600"):
        assert math.isclose(cost(m.encode(word)), best(pieces.MARK + word), rel_tol=1e-9)


def test_encoding_odd_rows(spark):
    pytest.importorskip("sentencepiece")
    m = pieces.Model.load()
    rows = [(1, None), (2, ""), (3, " a  b\n"), (3, " a  b\n"), (None, "x" * 100_000), (4, "word " * 50_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, ids int, _p int")
    out = pieces.decoded(pieces.encoded(df, m), m)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_p", "ids", "n_tokens", "n_byte_tokens", "intact", "decoded"])
    assert all(r.intact and r.decoded == (r.text or "") and len(r.ids) == r.n_tokens for r in out.collect()) and out.count() == len(rows)
    assert pieces.encoded(df.where("false"), m).count() == 0


def test_words_walked_together_as_alone():
    pytest.importorskip("sentencepiece")
    m = pieces.Model.load()
    rng = np.random.default_rng(3)
    letters = list("abcdefgh e\u00e9\u00df\u6f22\U0001f600\u0001\n'-1") + [pieces.MARK]
    units = ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(400)]
    assert m.viterbi_many(units) == [m.viterbi(u) for u in units]
    texts = [None, "", "a b", "x" * 5000, " ".join(units), "\u2581 \u2581"]
    assert list(m.encode_all(texts)) == [m.encode(t) for t in texts]


def test_url_rules_and_redirects(spark):
    link = '<link rel="canonical" href="https://bad.example.org/es/9">'
    rows = [(1, "http://x.org/a", None), (2, "http://a.example.org/es/1#t", ""), (3, "https://n.net/p", link), (4, "http://N.net/p#q", ""), (5, None, None), (6, "no host", ""), (7, "http://example.org/en/12", ""), (8, "http://bad.example.org/es/9", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("x.org", "/a", "org/", "allow") and got[2][2:] == ("example.org/es/", "block") and got[7][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == (None, "block") and got[4] == ("n.net", "/p", None, "block") and got[5] == got[6] == ("", "", None, "allow")


def test_url_targets_that_are_no_rows_and_relative_links(spark):
    def link(t):
        return f'<link rel="canonical" href="{t}">'

    rows = [(1, "http://n.net/p", link("https://bad.example.org/es/9")), (2, "http://a.net/", '<meta http-equiv="refresh" content="0; url=http://x.com/de/1">'), (3, "http://b.net/", link("http://x.com/de/1")), (4, "http://x.com/dir/a.html", link("../de/b?x=1&amp;y=2")), (5, "http://c.net/d/e", link("f.html") + link("http://x.com/de/7")), (6, "http://c.net/d/f.html", ""), (7, "http://d.net/q", link("?z=1")), (8, "http://e.net/q", link("mailto:a@b.c")), (9, "http://f.net/", link("http://x.com/de/1") + link("http://x.org/ok"))]
    got = {r.page_id: (r.verdict, r.alias_of) for r in url_rules.judge(spark.createDataFrame(rows[:8], "page_id long, url string, html string")).collect()}
    assert [got[k][0] for k in range(1, 9)] == ["block"] * 6 + ["allow"] * 2
    assert got[2][1] == got[3][1] == "a.net/" and got[4][1] == "x.com/de/b?x=1&y=2" and got[5][1] == got[6][1] and got[7][1] == "d.net/q" and got[8][1] == "e.net/q"
    got = {r.page_id: r.verdict for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == got[3] == got[9] == "allow"


def test_url_links_in_comments_and_odd_rows(spark):
    link = '<link rel="canonical" href="https://bad.example.org/es/9">'
    rows = [(1, "http://n.net/a", f"<!-- {link} -->"), (2, "http://n.net/b", f"<script>var x = '{link}'</script>"), (3, "http://n.net/c", link), (3, "http://n.net/c", link), (None, "http://n.net/c", None), (4, None, link), (5, "http://n.net/d" + "x" * 100_000, link)]
    df = spark.createDataFrame([(*r, "b", "c") for r in rows], "page_id long, url string, html string, host string, node string")
    got = sorted((-1 if r.page_id is None else r.page_id, r.verdict) for r in url_rules.judge(df).collect())
    assert got == [(-1, "block"), (1, "allow"), (2, "allow"), (3, "block"), (3, "block"), (4, "allow"), (5, "block")]
    assert url_rules.judge(df.where("false")).count() == 0
    chain = [(i, f"http://n.net/{i}", f'<meta http-equiv="refresh" content="0; url=/{i + 1}">') for i in range(40)] + [(99, "http://h.net/", "")] + [(100 + i, f"http://h.net/{i}", '<link rel="canonical" href="/">') for i in range(30)]
    got = {r.page_id: r.alias_of for r in url_rules.judge(spark.createDataFrame(chain, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(40)} == {"n.net/0"} and {got[99], *(got[100 + i] for i in range(30))} == {"h.net/"}


def test_targets_and_taken(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert math.isclose(sum(v[0].target for v in by.values()), 1.5 * sum(r.size for r in rows), rel_tol=1e-9)
    assert all(v[0].target <= 2 * v[0].source_size + 1e-6 for v in by.values())
    odd = spark.createDataFrame([(1, None, None), (2, "", None), (3, "a b", "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.size for r in mixing.mix(odd).collect()} == {1: 0, 2: 0, 3: 2}
    assert mixing.mix(odd.where("false")).count() == 0


def test_taken_equals_a_schedule_written_out(spark):
    rng = np.random.default_rng(4)
    rows = [(i if i % 50 else None, " ".join(["w"] * int(rng.integers(0, 300))), [None, "b", "a", "c"][i % 4] if i % 4 != 3 or i % 8 == 3 else "a") for i in range(400)] + [(7, "w w w", "b")] * 3
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, row int, h string")
    got = mixing.mix(df, block=16).collect()
    names = sorted({r.source for r in got if r.source is not None}) + [None]
    size = {s: sum(r.size for r in got if r.source == s) for s in names}
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left, w = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * size[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    assert all(math.isclose(r.target, target[r.source]) and r.source_size == size[r.source] for r in got)
    total, edge, at = sum(target.values()), [], 0.0
    for s in names:
        at += target[s]
        edge.append(at / total)
    order = []
    for slot in range(1, math.ceil(total / 16) + 1):
        x = slot * mixing.GOLDEN % mixing.POINTS / mixing.POINTS
        order.append(next((s for s, hi in zip(names, edge) if x < hi), None))
    slots = {}
    for r in mixing.mixed(df, block=16).collect():
        slots.setdefault(r.slot, [r.source, 0])[1] += r.words
    left = {s: math.floor(target[s] + 0.5) for s in names}
    for slot, source in enumerate(order, 1):  # scheduled slots in full blocks until the target is reached, to the word
        assert (slot in slots) == (left[source] > 0) and (slot not in slots or slots[slot][0] == source)
        left[source] -= slots.get(slot, [None, 0])[1]
    for slot in sorted(k for k in slots if k > len(order)):
        left[slots[slot][0]] -= slots[slot][1]
    assert set(left.values()) == {0} and sum(k > len(order) for k in slots) <= 3 * len(names)
    for s in names:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 0.5
    assert all(0 <= r.taken <= 2 * r.size for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("n", [3, 30, 3000])
def test_small_sources_meet_their_targets(spark, n):
    df = spark.createDataFrame([(i if i % 3 else None, "w " * (i % 7 + (20 if n == 3 else 1)), "abc"[i % 3]) for i in range(n)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5 and all(r.taken <= 2 * r.size for r in mine)


def test_mix_in_schedule_order_gives_what_is_taken(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").dropDuplicates(["doc_id"]).select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(-1, "a b c " * 50, None)], docs.schema))
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    rows = mixing.mixed(docs).orderBy("slot", "place").collect()
    got, end = {}, {}
    for r in rows:
        assert r.place == end.get(r.slot, 0)
        end[r.slot] = r.place + r.words
        got[r.doc_id] = got.get(r.doc_id, 0) + r.words
    assert got == want and -1 in got
    assert len({(r.slot, r.doc_id) for r in rows}) == len(rows) and len({r.slot for r in rows}) > 1000
    assert len({(r.slot, r.source, r.block) for r in rows}) == len({r.slot for r in rows})


def test_extract_drops_what_surrounds_the_article():
    page = '<html><body><nav>menu</nav><div class="cookie-notice">we use</div><article><h1>T &amp; x</h1><p>one<br>two<p>three <b>four</b></article><div class="comments"><p>hi there</p></div><footer>f</footer>'
    assert extract.text_of(page, None) == "T & x\none two\nthree four"
    assert extract.text_of(None, None) == extract.text_of("", "/x") == ""


def test_extract_keeps_the_whole_article():
    a, b = "first section " * 20, "second part "
    wrap = f'<body><div class="wrap"><h1>T</h1><div class="entry-content"><p>{a}</p></div><div class="more"><p>{b}</p></div></div><div class="links"><a href="/">one link</a><a href="/2">other link</a></div>'
    whole = "\n".join(("T", a.strip(), b.strip()))
    assert extract.text_of(wrap, None) == whole
    assert extract.text_of(wrap, extract.best_path(wrap)) == whole
    assert extract.text_of(f'<article><h1>T</h1><div class="container"><div class="row"><div class="content"><p>{a}</p></div></div></div></article>', None) == f"T\n{a.strip()}"
    other = f'<body><article><p>{a}</p></article><section class="extra"><a href="/">x</a> few</section>'
    assert extract.text_of(other, "/body/section.extra").startswith(a.strip())
    assert a.strip() in extract.text_of(f'<article><svg class="x"/><p>{a}</p></article>', None)
    assert a.strip() in extract.text_of(f"<article><iframe src=x><p>{a}</p></article>", None)


def test_extract_judges_names_by_their_main_word():
    a = "first section of some length " * 12
    body = f"<p>{a}</p>"
    for page in (f'<div class="content has-sidebar">{body}</div>', f'<div class="page no-ads">{body}</div>', f'<main class="with-menu">{body}</main>'):
        assert extract.text_of(page, None) == a.strip(), page
    assert extract.text_of(f'<article><header><h1>T</h1></header>{body}<p class="search-results">kept</p><div class="post-footer">gone</div><div class="leftSidebar">gone</div></article>', None) == f"T\n{a.strip()}\nkept"
    assert extract.text_of(f'<body><header>Site</header><div id="comments">{body}</div></body>', None) == ""
    assert extract.text_of(f'<div id="modal-root"><nav>n</nav><main>{body}</main></div>', None) == a.strip()
    assert extract.text_of('<body><div class="cookie-notice">we use cookies</div></body>', None) == ""


NOISE = "reader-comments-section user-comments-list notice-box banner-top share-buttons widget-area modal-dialog alert-box header-top top-menu-bar readerComments"


@pytest.mark.parametrize("name", NOISE.split())
def test_extract_judges_any_word_of_a_name_at_any_length(name):
    for a, b in (("a few words", "other words"), ("a few words " * 90, "other words " * 200)):
        page = f'<body><article><p>{a}</p><div class="{name}"><p>{b}</p></div></article></body>'
        assert extract.text_of(page, None) == a.strip(), name
        assert extract.text_of(f'<body><div class="{name}"><p>{b}</p></div></body>', None) == ""


@pytest.mark.parametrize("part", ["<b>", "<div>", "</i>", "<script>", "<p><b>", "<a href=x>y", "<hr>", "<b x='", "<div class=c>t", "<!--", "<td><i>", "<b "])
def test_extract_of_a_long_odd_page_is_linear(part):
    import time

    began = time.time()
    extract.text_of("<article><p>start</p>" + part * (1_000_000 // len(part)) + "end", "/article")
    assert time.time() - began < 20
    for odd in (f"<i><div>{'<b>' * 60_000}{'</i>' * 60_000}", "<b>" * 60_000 + "<hr>" * 60_000, "<div>" * 60_000 + "t</div>" * 60_000):
        began = time.time()
        extract.text_of(odd, None)
        assert time.time() - began < 20


def test_extract_votes_for_each_host(spark):
    a, b = "text of an article " * 20, "words that the host shows besides " * 30
    page = lambda k: f'<body><div class="story{k}"><p>{a}{k}</p></div><div class="extra">' + (f"<p>{b}</p>" if k == 3 else "") + "</div></body>"
    rows = [(k, f"http://h.net/{k}", page(k)) for k in range(6)] + [(6, None, page(1)), (7, "http://e.net", None), (8, "x", ""), (1, "http://h.net/1", page(1))]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, text int")
    for most in (8 << 20, 0):
        got = sorted((r.page_id, r.text, r.n_chars) for r in extract.extract(pages, path_bytes=most).collect())
        assert len(got) == 10 and [g for g in got if g[0] in (7, 8)] == [(7, "", 0), (8, "", 0)]
        assert all(g[1].startswith("text of an article") and str(g[0] % 6 if g[0] < 6 else 1) in g[1] and g[2] == len(g[1]) for g in got if g[0] < 7)
    assert extract.extract(pages.where("false")).count() == 0


def test_every_notice_of_a_text_is_found():
    for text, want in (("mozila public license mozilla public license", [(0, 21, 1), (22, 44, 0)]), ("all right reserved all rights reserved", [(0, 18, 1), (19, 38, 0)]), ("a b all rights reserved", [(4, 23, 0)])):
        phrase, edits = (("mozilla public license", 2) if "public" in text else ("all rights reserved", 1))
        assert license_scan.fuzzy(text, phrase, edits) == want
    # brute force: every place where the words of the phrase stand with at most so many edits
    rng = np.random.default_rng(2)
    phrase = "gnu general public license"
    for _ in range(60):
        words = [rng.choice(["gnu", "general", "public", "licence", "license", "gnu general public", "x", "generl"]) for _ in range(12)]
        text = " ".join(words)
        pat = license_scan.pattern(phrase, 2)
        want = any(pat.fullmatch(" ".join(text.split()[i:j])) for i in range(len(text.split())) for j in range(i + 1, min(i + 7, len(text.split()) + 1)))
        assert bool(license_scan.fuzzy(text, phrase, 2)) == want, text


def test_licenses_of_odd_rows(spark):
    rows = [(1, "Under the MIT license " * 3), (1, "Under the MIT license " * 3), (None, None), (2, ""), (3, "z " * 200_000 + "cc by nc")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, labels string, n_base int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, len(r.found)) for r in license_scan.licenses(df).collect())
    assert got == [(-1, 0, 0, None, None, "", 0), (1, 12, 3, 0, 8, "mit", 3), (1, 12, 3, 0, 8, "mit", 3), (2, 0, 0, None, None, "", 0), (3, 200_003, 1, 200_000, 200_000, "cc-by-nc", 0)]
    assert license_scan.licenses(df.where("false")).count() == 0


def test_license_places_and_edits():
    n, base, first, last, own, every, score, _ = license_scan.scan("Foo. Under the MIT-license, apache License: version 2; mozila public license")
    assert (n, base, first, last, own) == (12, 2, 1, 5, "apache-2,mit") and "mpl" in every and score == 1.0
    assert license_scan.scan(None)[:4] == (0, 0, None, None)


def test_index_of_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 if i in (0, 77, 199) else 1 if i == 5 else 8).tolist(), "x") for i in range(200)] + [(300, None, "x"), (301, [0.0] * 8, "x"), (302, [1.0, float("nan")], "x"), (303, [1.0, None], "x"), (7, rng.normal(size=8).tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in multi_index.neighbours(df, df.where("vec_id % 20 = 0 or vec_id in (5, 77)"), share=1.0).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    fine = [(i, np.array(v)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    for q, v in [(i, v) for i, v in fine if i % 20 == 0 or i == 77]:
        want = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in fine if j != q and len(w) == len(v))[:10]
        assert [j for _, j in sorted(got[q])] == [j for _, j in want]
    assert 5 not in got and len(got[0]) == 2


def test_long_odd_pages_and_texts_are_linear(spark):
    pages = [(1, "http://n.net/a", "<link " * 170_000), (2, "http://n.net/b", "<meta " * 170_000), (3, "http://n.net/c", "<link " + "rel=" * 250_000 + ">"), (4, "http://n.net/d", '<link rel="canonical" href="/z"' + " " * 500_000 + "><meta http-equiv=refresh content='0;url=/y'>")]
    import time

    began = time.time()
    got = {r.page_id: r.alias_of for r in url_rules.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "n.net/a", 2: "n.net/b", 3: "n.net/c", 4: "n.net/d"} and time.time() - began < 60
    began = time.time()
    got = license_scan.scan("CC by-nc é " * 100_000)
    assert got[:4] == (400_000, 100_000, 0, 399_996) and time.time() - began < 20


def test_rows_of_large_classes_are_named_without_meeting(spark):
    rows = [(i, 3, b"hot") for i in range(50)] + [(100 + i, 4, b"two") for i in range(2)] + [(200, 5, b"own"), (None, 3, b"hot"), *[(300 + i, 0, b"") for i in range(40)]]
    every = spark.createDataFrame(rows, "id long, n long, key binary")
    named = spark.createDataFrame([(3, b"hot", 7, 50), (4, b"two", 8, 2)], "n long, key binary, component_id long, copies long")
    for copies in (10, 1000):
        out = ngram_join.hub_named(every, named, copies)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
        want = [(i, n, None if i is None else {3: 7, 4: 8}.get(n, i)) for i, n, _ in rows]
        assert got == sorted(want, key=str)


def test_copies_of_one_text_and_empty_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base) for i in range(1200)] + [(2000 + i, base + f" more{i}") for i in range(30)] + [(3000 + i, "" if i % 2 else None) for i in range(200)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c == (0 if i < 3000 else i) for i, c in got.items()) and len(got) == len(rows)
