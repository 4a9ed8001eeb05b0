"""DuckDB SQL of the queries that SQL can express."""

OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM sized GROUP BY source),
s1 AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE ([3.0::DOUBLE, 1.0, 2.0])[(rk - 1) % 3 + 1] END AS w, 2.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / nullif(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lev,
         row_number() OVER o AS place
  FROM s1 WINDOW o AS (ORDER BY cap / nullif(w, 0) ASC NULLS LAST, rk)),
s3 AS (SELECT min(place) AS stop FROM s2 WHERE w > 0 AND lev * w <= cap),
s4 AS (
  SELECT source, rk, source_size, CASE WHEN w = 0 THEN 0.0 WHEN place < (SELECT stop FROM s3) THEN cap ELSE (SELECT lev FROM s2 WHERE place = (SELECT stop FROM s3)) * w END AS target FROM s2),
src AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS whole FROM s4),
docs AS (
  SELECT z.*, CAST(coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sized z),
total AS (SELECT CAST(sum(whole) AS BIGINT) AS words, (CAST(sum(whole) AS BIGINT) + 63) // 64 AS n FROM src),
spans AS (
  SELECT rk, source, whole, CAST(coalesce(sum(whole) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST((SELECT words FROM total) AS DOUBLE) AS lo,
         CAST(sum(whole) OVER (ORDER BY rk) AS DOUBLE) / CAST((SELECT words FROM total) AS DOUBLE) AS hi
  FROM src),
turns AS (
  SELECT i, CAST(i // 1048576 AS DOUBLE) * CAST('0.607787409740350972' AS DOUBLE) + CAST(i % 1048576 AS DOUBLE) * CAST('0.6180339887498949' AS DOUBLE) AS x FROM range((SELECT n FROM total)) t(i)),
hits AS (
  SELECT t.i AS slot, s.rk, row_number() OVER (PARTITION BY s.rk ORDER BY t.i) - 1 AS nth FROM turns t JOIN spans s ON t.x - floor(t.x) >= s.lo AND t.x - floor(t.x) < s.hi),
late AS (
  SELECT (SELECT n FROM total) + rk AS slot, rk, unnest(range(coalesce((SELECT count(*) FROM hits h WHERE h.rk = s.rk), 0), (whole + 63) // 64)) AS nth FROM spans s),
slots AS (SELECT slot, rk, nth FROM hits UNION ALL SELECT slot, rk, nth FROM late)
SELECT d.doc_id, d.size, s.source_size, s.target,
       greatest(0, least(d.start + d.size, s.whole) - d.start) + greatest(0, least(s.source_size + d.start + d.size, s.whole) - s.source_size - d.start) AS taken,
       CASE WHEN d.size > 0 AND d.start < s.whole THEN l.slot END AS first_slot
FROM docs d JOIN src s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN slots l ON l.rk = s.rk AND l.nth = d.start // 64
"""

CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _escaped(c: str) -> str:
    c = f"replace({c}, chr(92), chr(92) || chr(92))"
    for s in CONTROL:
        c = f"replace({c}, '{s}', '{s[0]}' || chr(92) || '{s[1:]}')"
    return c


OP1 = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_escaped("role")}) + length({_escaped("text")}) + {len("<|im_start|>") + len("<|im_sep|>") + len("<|im_end|>") + 1}) AS BIGINT) AS formatted_chars
FROM every GROUP BY conv_id
"""

ORACLE_SQL = {"op1_chat_formatting": OP1, "op6_mixing": OP6}
