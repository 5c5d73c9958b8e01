"""The readers of cuebook.sources.tables, in SQL, for the oracles."""

LOG = """(SELECT o_orderkey AS task_id, o_orderdate AS requested_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 90 SECOND END AS completed_at,
 CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END AS status, o_totalprice / 1e5 AS cost, CAST(floor(o_totalprice) AS BIGINT) AS tokens,
 o_orderkey % 4000 / CAST(8 AS DOUBLE) AS duration, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 50 + CAST(0.25 AS DOUBLE) END AS processing, o_orderpriority AS model, o_custkey AS batch_id,
 CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_batch, 'audio_' || o_orderkey || '.mp3' AS filename, 'Talk ' || o_custkey || '%' AS title,
 CASE WHEN o_orderkey % 5 > 0 THEN 's-' || (o_custkey % 100) END AS session_id, 'f' || o_orderkey AS file_uid, CASE WHEN o_orderkey % 2 = 0 THEN '[00:01.00] ' || o_orderpriority END AS lrc_content,
 CASE o_orderkey % 4 WHEN 0 THEN 'Google' WHEN 1 THEN 'OpenAI' END AS provider, CASE WHEN o_orderkey % 3 > 0 THEN 'ja-JP' END AS source_language, CASE WHEN o_orderkey % 6 = 1 THEN 'zh-TW' END AS target_language,
 CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'code ' || (500 + o_orderkey % 5) END AS error_message FROM orders)"""
CUES = r"""(SELECT conv_id AS file_id, turn AS line_no, turn * 7250 + conv_id % 10 * 101 AS start_ms, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM conversations)"""
ENDS = f"(SELECT *, coalesce(lead(start_ms) OVER w, start_ms + 5000) AS end_ms, row_number() OVER w AS number FROM {CUES} c WINDOW w AS (PARTITION BY file_id ORDER BY line_no))"
def exact(x: str, digits: int) -> str:
    """A double rounded on its exact binary value, by printing it."""
    return f"CAST(format('{{:.{digits}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


STATS = f"""count(*) AS total, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed,
 coalesce({exact("count(*) FILTER (WHERE status = 'COMPLETED') / CAST(nullif(count(*), 0) AS DOUBLE) * 100", 1)}, 0.0) AS success_rate, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens,
 coalesce({exact('sum(CAST(cost AS DECIMAL(24,9)))', 6)}, 0.0) AS cost, coalesce({exact('sum(duration)', 1)}, 0.0) AS duration,
 coalesce({exact("avg(processing) FILTER (WHERE status = 'COMPLETED')", 1)}, 0.0) AS processing"""
