"""SQL of the operators that SQL can express, for DuckDB."""

CLOSURE = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
 least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 fine AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM fine p JOIN fine q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.93),
 {CLOSURE},
 n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
 SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(l.b, v.vec_id)) AS component_id, v.vec_id <= coalesce(l.b, v.vec_id) AS kept
 FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN least l ON v.vec_id = l.a"""

OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 h AS (SELECT doc_id, s FROM s JOIN (SELECT s FROM s GROUP BY s HAVING count(*) > 1) USING (s)),
 both_have AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM h p JOIN h q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
 {CLOSURE}
 SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(l.b, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least l ON w.doc_id = l.a"""

RULE = "CASE WHEN {0} THEN {1} WHEN {2} THEN {3} WHEN {4} THEN {5} WHEN {6} THEN {7} WHEN {8} THEN {9} END"
FITS = [("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("org", "/", "allow")]


def _ruled(host: str, path: str, verdict: bool) -> str:
    parts = []
    for h, p, v in FITS:
        parts += [f"({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}')", f"'{v if verdict else h + p}'"]
    return RULE.format(*parts)


LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
HOST = LOW.format("regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1)")
PATH = "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
NODE = f"nullif({HOST}, '') || regexp_extract({{0}}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
SEEN = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')"
TAGS = r"""list_concat(regexp_extract_all(seen, '(?is)<link\b[^>]*\brel\s*=\s*["'']?[^"''>]*canonical[^>]*>'), regexp_extract_all(seen, '(?is)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*>'))"""
#: Absolute link targets only: relative ones are resolved by the operator and tested by hand.
OP6 = rf"""WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, coalesce({SEEN}, '') AS seen FROM pages),
 base AS (SELECT page_id, {HOST.format('url')} AS host, {PATH.format('url')} AS path, {NODE.format('url')} AS node, seen FROM p),
 t AS (SELECT node AS a, replace(regexp_extract(tag, '(?is)(?:href|url)\s*=\s*["'']?\s*([^"''>\s]+)', 1), '&amp;', '&') AS target FROM (SELECT node, unnest({TAGS}) AS tag FROM base WHERE node IS NOT NULL)),
 links AS (SELECT a, {NODE.format('target')} AS b FROM t WHERE contains(target, '://') AND {NODE.format('target')} <> a),
 {CLOSURE},
 nodes AS (SELECT a, least(a, b) AS top, {_ruled(HOST.format("'http://' || a"), PATH.format("'http://' || a"), True)} AS said FROM least),
 votes AS (SELECT top, bool_or(said = 'block') AND NOT coalesce(bool_or(said = 'allow'), false) AS bad FROM nodes GROUP BY top)
 SELECT page_id, host, path, {_ruled('host', 'path', False)} AS rule, coalesce({_ruled('host', 'path', True)}, CASE WHEN bad THEN 'block' END, 'allow') AS verdict, coalesce(n.top, node) AS alias_of
 FROM base LEFT JOIN nodes n ON base.node = n.a LEFT JOIN votes v ON n.top = v.top"""

OP8 = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, row_number() OVER () AS id, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS h FROM documents),
 z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS k FROM d GROUP BY source),
 w AS (SELECT *, CAST([3, 1, 2][(k - 1) % 3 + 1] AS DOUBLE) AS w, 2.0 * source_size AS cap, sum(source_size) OVER () * 1.5 AS whole, sum(CAST([3, 1, 2][(k - 1) % 3 + 1] AS DOUBLE)) OVER () AS weights FROM z),
 f AS (SELECT *, whole - coalesce(sum(cap) OVER o, 0) AS rest, weights - coalesce(sum(w) OVER o, 0) AS w_rest FROM w WINDOW o AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT min_by(rest / w_rest, cap / w) AS level FROM f WHERE cap / w > rest / w_rest),
 q AS (SELECT source, source_size, k, CASE WHEN level IS NULL OR cap / w <= level THEN cap ELSE level * w END AS target FROM f, l),
 line AS (SELECT d.*, q.source_size, q.target, CAST(floor(q.target + 0.5) AS BIGINT) AS owed, sum(size) OVER (PARTITION BY q.k ORDER BY h, doc_id, size, id) - size AS a FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
 SELECT doc_id, size, source_size, target, CAST(greatest(least(a + size, owed) - a, 0) + greatest(least(a + size, owed - source_size) - a, 0) AS BIGINT) AS taken, source FROM line"""

def _crc_table() -> list[int]:
    """CRC-32 of the numbers 0 to 15, by its polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, half a byte a step."""
    digits = f"string_split(hex(encode({text})), '')"
    halves = f"list_transform(generate_series(0, octet_length(encode({text})) * 2 - 1), lambda i: CAST(strpos('0123456789ABCDEF', {digits}[xor(i, 1) + 1]) - 1 AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {halves}), lambda c, x: xor(c >> 4, CAST({_crc_table()} AS BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295)"


BITS = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"
#: Cells of the key as the rounds see them: the number read and its shift, in order; the last is one row.
LEVELS = ", ".join(f"({i}, {w}, {s})" for i, (w, s) in enumerate((w, s) for w in (0, 1) for s in (48, 38, 28, 18, 8, 0)))
OP11 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 d AS (SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, {crc32('text')} AS text_crc32, {BITS.format('text')} AS h, {BITS.format('CAST(doc_id AS VARCHAR)')} AS r FROM t),
 k AS (SELECT *, CAST(sum(size) OVER (ORDER BY h, r) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total FROM d),
 goals AS (SELECT g, h, r, total FROM k, generate_series(1, 15) t(g) WHERE (upto - size) * 16 <= g * total AND upto * 16 > g * total),
 edges AS (SELECT g, l.i, any_value(goals.total) AS total, min(k.upto - k.size) AS lo, max(k.upto) AS hi FROM goals, (VALUES {LEVELS}) l(i, w, s), k
  WHERE CASE WHEN w = 0 THEN k.h >> s = goals.h >> s ELSE k.h = goals.h AND k.r >> s = goals.r >> s END GROUP BY g, l.i),
 tried AS (SELECT g, i, total, CASE WHEN g * total - lo * 16 <= hi * 16 - g * total THEN lo ELSE hi END AS cut FROM edges),
 cuts AS (SELECT g, cut FROM tried WHERE abs(cut * 16 - g * total) * 1000 <= total OR i = 11 QUALIFY row_number() OVER (PARTITION BY g ORDER BY i) = 1),
 s AS (SELECT *, CAST((SELECT count(*) FROM cuts WHERE cut <= upto - size) AS INTEGER) AS shard FROM k)
 SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, r) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

WORDS = "regexp_extract_all(" + LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS id, {WORDS} AS words FROM documents),
 full_ AS (SELECT doc_id, id, CAST(len(words) AS BIGINT) AS n, words FROM d WHERE len(words) > 0),
 a AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM full_),
 q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL),
 p AS (SELECT id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT id, unnest(words) AS term FROM full_) SEMI JOIN q USING (term) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY term, docs),
 i AS (SELECT id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS impact FROM p JOIN full_ USING (id) JOIN w USING (term), a),
 s AS (SELECT item_id, id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(times * impact) > 0)
 SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 20"""

ORACLES = {"op1_embedding_neardup": OP1, "op3_ngram_jaccard": OP3, "op6_url_filters": OP6, "op8_source_mix": OP8, "op11_sharding": OP11, "op13_lexical_search": OP13}
