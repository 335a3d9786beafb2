r"""DuckDB SQL of the operators that SQL expresses."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(text, '(<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<s>|</s>)', '\\\1', 'g') AS body
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(url_encode(role)) + 1 + length(body) + 1 + length('<|im_end|>') + 1)
       AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda w: w <> '') AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, range(0, 8) r(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(lines) AS x FROM d),
worded AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS k FROM ln WHERE regexp_matches(x, '{WORD}')
           GROUP BY doc_id),
bad AS (
  SELECT doc_id, sum(length(regexp_replace(x, '{SPACE}', '', 'g'))) AS lost FROM ln
  WHERE regexp_matches(x, '{WORD}') AND (
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 10 > length(x)
    OR NOT regexp_matches(right(x, 8), '[.!?:;…。！？]["''»”’)\]]*[\x20\x09-\x0D]*$')
    OR len(regexp_extract_all(x, '!!')) * 3 > len(regexp_extract_all(x, '{WORD}'))
    OR regexp_matches(x, '(^|[\x20\x09])[|»›•>][\x20\x09].*[\x20\x09][|»›•>]([\x20\x09]|$)')
    OR regexp_matches(x, '(?i)(all rights reserved|cookie policy|accept cookies|enable javascript|privacy policy|terms of (use|service)|click here|sign up now|log in to|subscribe to our|licensed under the)'))
  GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(worded.n - worded.k, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN worded USING (doc_id) LEFT JOIN bad USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (lost * 100 > word_chars * 50) AS kept
FROM base
"""



def _vector_codes(parts: int = 4, width: int = 16, rounds: int = 4) -> str:
    """Codebooks round by round; vectors of the table hold parts * width components."""
    floor = "CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)"
    distance = " + ".join(f"(p.v[{i}] - b.v[{i}]) * (p.v[{i}] - b.v[{i}])" for i in range(1, width + 1))
    # division of longs, rounded down
    mean = ", ".join(f"CAST((sum(p.v[{i}]) - ((sum(p.v[{i}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
                     for i in range(1, width + 1))
    slices = " UNION ALL ".join(f"SELECT vec_id, label, row, {k} AS pos, v[{k * width + 1}:{(k + 1) * width}] AS v FROM kept"
                                for k in range(parts))
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT p.row, p.pos, min(({distance}) * 256 + b.entry) AS best
  FROM pieces p JOIN book{r} b USING (pos) GROUP BY p.row, p.pos)""")
        if r < rounds:
            steps.append(f"""
book{r + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT p.pos, n.best % 256 AS entry, [{mean}] AS v
    FROM pieces p JOIN near{r} n USING (row, pos) GROUP BY p.pos, n.best % 256) m USING (pos, entry))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row,
    list_transform(embedding, lambda x: {floor}) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED ({slices}),
book0 AS MATERIALIZED (SELECT pos, row AS entry, v FROM pieces WHERE row < 256),{",".join(steps)},
coded AS (
  SELECT vec_id, any_value(k.label) AS label, string_agg(printf('%02x', n.best % 256), '' ORDER BY pos) AS code,
    CAST(sum(n.best // 256) AS BIGINT) AS error
  FROM near{rounds} n JOIN kept k USING (row) GROUP BY row, vec_id),
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest
"""


SQL = {"op3_chat_format": CHAT, "op4_quality_rules": QUALITY, "op13_vector_codes": _vector_codes()}
