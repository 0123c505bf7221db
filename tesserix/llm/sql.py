"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import zlib

from tesserix.llm import chat, quality


def _crc_table() -> str:
    return "[" + ",".join(str(_crc_step(n)) for n in range(256)) + "]"


def _crc_step(n: int) -> int:
    for _ in range(8):
        n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
    return n


def _op3() -> str:
    assert zlib.crc32(b"a") == _crc_step(0xFF ^ ord("a")) ^ 0x00FFFFFF ^ 0xFFFFFFFF
    return f"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS tie FROM documents
), sized AS (
  SELECT doc_id, tie, (octet_length(encode(body)) + 1)::BIGINT AS size,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: (ord(h[1]) - CASE WHEN ord(h[1]) > 57 THEN 55 ELSE 48 END) * 16 + (ord(h[2]) - CASE WHEN ord(h[2]) > 57 THEN 55 ELSE 48 END)::BIGINT)),
      lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM raw
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size, tie ROWS UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32, size, tie) AS rn FROM sized
), sharded AS (
  SELECT *, least(7, ((2 * upto - size) * 8) // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, rn - min(rn) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard
FROM sharded
"""


OP5 = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), shown AS (
  SELECT s.*, p.perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), led AS (
  SELECT *, '{chat.OPEN}' || role || CASE WHEN role = 'user' THEN '{chat.NAME}' || replace(replace(speaker, '<|', '< |'), chr(10), ' ') ELSE '' END || chr(10) AS lead FROM shown
), segs AS (
  SELECT *, lead || replace(body, '<|', '< |') || '<|im_end|>' || chr(10) AS segment FROM led
), placed AS (
  SELECT *, row_number() OVER w - 1 AS seq,
    sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM segs WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(body))
)
SELECT conv_id, perspective, seq, turn, speaker, role, segment, stop - length(segment) AS start, stop AS "end",
  CASE WHEN role = 'assistant' THEN stop - length(segment) + length(lead) END AS mask_start,
  CASE WHEN role = 'assistant' THEN stop END AS mask_end
FROM placed
"""

_STOPS = ",".join(f"'{w}'" for w in quality.STOP_WORDS)
_RATIO = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "shout_ratio": "n_shouts / greatest(n_words, 1)", "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "stop_word_ratio": "n_stop_words / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
}


def _bad(name: str, least: float | None, most: float | None, n_words: int) -> str:
    tests = ([] if least is None else [f"{_RATIO[name]} < {least}"]) + ([] if most is None else [f"{_RATIO[name]} > {most}"])
    return f"CASE WHEN n_words >= {n_words} AND ({' OR '.join(tests)}) THEN '{name}' END"


OP6 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), wins AS (
  SELECT rid, p, w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+3] || ' ' || w[p+4] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM d)
), dup AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM wins) WHERE c > 1
), cover AS (
  SELECT rid, sum(least(5, coalesce(nxt - p, 5)))::BIGINT AS n FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM dup) GROUP BY rid
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(body, '[^!?]+', '', 'g')) AS n_shouts,
    length(regexp_replace(body, '\\P{{Lu}}+', '', 'g')) AS n_upper,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words
  FROM d LEFT JOIN cover USING (rid)
), j AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    concat_ws(',', {", ".join(_bad(*r) for r in quality.RULES)}) AS failed_rules FROM m
)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM j
"""

TWINS: dict[str, str] = {"op3_byte_shards": _op3(), "op5_chat_perspectives": OP5, "op6_quality_rules": OP6}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, l, p, array_to_string(w[p : p + l - 1], ' ') AS g
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)
), hits AS (
  SELECT DISTINCT rid, dw.l, p, item_id FROM dw JOIN bw USING (l, g)
), covered AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + l)) AS q FROM hits) GROUP BY rid
), ids AS (
  SELECT rid, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids.s, '')) AS items_sha256,
  coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN ids USING (rid)
"""
TWINS["op2_decontamination"] = OP2

OP4 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, doc_id, p, array_to_string(w[p : p + 19], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)
), dup AS (
  SELECT rid, p FROM (
    SELECT rid, p, doc_id, min(coalesce(doc_id, -9223372036854775808)) OVER (PARTITION BY g) AS d0, min(p) OVER (PARTITION BY g, doc_id) AS p0 FROM win
  ) WHERE coalesce(doc_id, -9223372036854775808) > d0 OR p > p0
), gone AS (
  SELECT DISTINCT rid, unnest(range(p, p + 20)) AS q FROM dup
), removed AS (
  SELECT rid, count(*) AS n FROM gone GROUP BY rid
), kept AS (
  SELECT rid, string_agg(x, ' ' ORDER BY q) AS s
  FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN gone USING (rid, q) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(removed.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (rid) LEFT JOIN kept USING (rid)
"""
TWINS["op4_passage_dedup"] = OP4
