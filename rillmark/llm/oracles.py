"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rillmark.llm.mixing import BLOCKS

#: Words of op9: regexp_extract_all with the same class.
_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"

_OP9 = rf"""
WITH d AS (SELECT doc_id, source, {_SIZE} AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no FROM t),
w AS (SELECT *, [5, 2, 1][(no % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM n),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::BIGINT - (sum(cap) OVER r - cap)::BIGINT)
        / (sum(weight) OVER () - (sum(weight) OVER r - weight)) AS level
      FROM w WINDOW r AS (ORDER BY cap::DOUBLE / weight, no ROWS UNBOUNDED PRECEDING)),
s AS (SELECT source, no, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
wd AS (SELECT greatest(1.0::DOUBLE, sum(target) / {BLOCKS}) AS width FROM s),
b0 AS (SELECT no, unnest(range(ceil(target / width)::BIGINT)) AS block, 0 AS node FROM s, wd),
b1 AS (SELECT no, block, 2 * node + (2 * row_number() OVER (PARTITION BY node ORDER BY md5('mix:0:' || no || ':' || block), no, block)
        > count(*) OVER (PARTITION BY node) + 1)::INT AS node FROM b0),
b2 AS (SELECT no, block, 2 * node + (2 * row_number() OVER (PARTITION BY node ORDER BY md5('mix:1:' || no || ':' || block), no, block)
        > count(*) OVER (PARTITION BY node) + 1)::INT AS node FROM b1),
b3 AS (SELECT no, block, 2 * node + (2 * row_number() OVER (PARTITION BY node ORDER BY md5('mix:2:' || no || ':' || block), no, block)
        > count(*) OVER (PARTITION BY node) + 1)::INT AS node FROM b2),
p AS (SELECT d.doc_id, d.size, s.no, s.source_size, s.target, wd.width,
        sum(d.size) OVER (PARTITION BY s.no ORDER BY h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size + d.size / 2 AS mid
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, wd),
q AS (SELECT *, CASE WHEN size > 0 AND mid < target THEN floor(mid / width)::BIGINT END AS b_1,
        CASE WHEN size > 0 AND source_size + mid < target THEN floor((source_size + mid) / width)::BIGINT END AS b_2 FROM p)
SELECT q.doc_id, q.size, q.source_size, q.target,
       q.size * ((x.node IS NOT NULL)::BIGINT + (y.node IS NOT NULL)::BIGINT) AS taken, x.node AS shard_1, y.node AS shard_2
FROM q LEFT JOIN b3 x ON x.no = q.no AND x.block = q.b_1 LEFT JOIN b3 y ON y.no = q.no AND y.block = q.b_2
"""

def _base32(digest: str) -> str:
    """Base 32 of a hex digest, 5 hex digits (20 bits) at a time."""
    digits = []
    for k in range(8):
        number = f"('0x' || substr({digest}, {5 * k + 1}, 5))::BIGINT"
        digits += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({number} >> {shift}) & 31)::INT + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(digits)


_OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, row_number() OVER () AS r FROM pages),
h AS (SELECT page_id, r, payload, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
o AS (SELECT *, first_value(page_id) OVER w AS head, row_number() OVER w AS nth FROM h
      WINDOW w AS (PARTITION BY payload ORDER BY page_id NULLS FIRST, r))
SELECT page_id, payload_bytes, {_base32('hex')} AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN head END AS refers_to
FROM o
"""

_OP3 = r"""
WITH t AS (SELECT conv_id, turn, role, text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
             '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said,
             coalesce('r' || strlen(role) || ':' || role, 'n') || coalesce('t' || strlen(text) || ':' || text, 'n') AS code
           FROM conversations),
w AS (SELECT conv_id, count(*) AS n_turns, string_agg(said, '' ORDER BY k) AS text, string_agg(code, '' ORDER BY k) AS code FROM t GROUP BY conv_id),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY code, n_turns ORDER BY conv_id NULLS FIRST) = 1),
p AS (SELECT t.k, string_agg(t.code, '') OVER (PARTITION BY t.conv_id ORDER BY t.k ROWS UNBOUNDED PRECEDING) AS code, w.n_turns
      FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id)
SELECT conv_id, n_turns, text FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = f.n_turns AND p.code = f.code AND p.k < p.n_turns)
"""

ORACLES: dict[str, str] = {"op3_chat_collapse": _OP3, "op5_warc_round_trip": _OP5, "op9_mix_sources": _OP9}
