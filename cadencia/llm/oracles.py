"""DuckDB SQL for the queries that SQL can express."""

from .license_scan import CONTAINMENT, SIZE, TEMPLATES, classes, word_count

LICENSES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())

CLASSES = classes(max(map(word_count, TEMPLATES.values())))

ORACLES: dict[str, str] = {
    "op1_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT k, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS gram
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), c AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g
), r AS (
  SELECT k, count(DISTINCT i + o) AS n_repeat_words
  FROM c, (SELECT unnest([0, 1, 2]) AS o) WHERE n >= 2 GROUP BY k
), f AS (
  SELECT w.k, doc_id, t, ws, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.k = r.k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 40 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 100 * len(regexp_extract_all(t, '\p{Lu}')) > 60 * len(regexp_extract_all(t, '\p{L}'))
            OR 100 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 40 * n_words) AS kept
FROM f
""",
    "op5_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, [length(x) + length(x) - length(replace(x, '\', ''))
             + (length(x) - length(replace(x, '<|', ''))) // 2
             + (length(x) - length(replace(x, '<s>', ''))) // 3
             + (length(x) - length(replace(x, '</s>', ''))) // 4
             + (length(x) - length(replace(x, '[INST]', ''))) // 6
             + (length(x) - length(replace(x, '[/INST]', ''))) // 7
             + (length(x) - length(replace(x, '<<SYS>>', ''))) // 7
             + (length(x) - length(replace(x, '<</SYS>>', ''))) // 8 for x in [role, text]] AS sizes
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(sizes[1] + sizes[2] + 26) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_license_scan": rf"""
WITH t0 AS (
  SELECT license, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws
  FROM (VALUES {LICENSES}) AS v(license, text)
), t AS (
  SELECT DISTINCT license, (SELECT min(c) FROM (SELECT unnest([{", ".join(map(str, CLASSES))}]) AS c) WHERE c >= len(ws)) AS s,
         array_to_string(ws[i : i + {SIZE - 1}], ' ') AS g
  FROM (SELECT license, ws, unnest(range(1, len(ws) - {SIZE - 2})) AS i FROM t0)
), total AS (
  SELECT license, count(*) AS n FROM t GROUP BY license
), d AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT k, i - 1 AS p, array_to_string(ws[i : i + {SIZE - 1}], ' ') AS g
  FROM (SELECT k, ws, unnest(range(1, len(ws) - {SIZE - 2})) AS i FROM d WHERE len(ws) >= {SIZE})
), h AS (
  SELECT k, license, g.g, s, unnest(range(greatest(0, CAST(ceil((p - 2 * s + {SIZE}) / CAST(s AS DOUBLE)) AS BIGINT)), p // s + 1)) AS w
  FROM g JOIN t ON g.g = t.g
), m AS (
  SELECT k, h.license, w, count(DISTINCT g) / CAST(any_value(n) AS DOUBLE) AS containment
  FROM h JOIN total ON h.license = total.license GROUP BY k, h.license, w
), b AS (
  SELECT k, license, max(containment) AS containment FROM m WHERE containment >= {CONTAINMENT} - 1e-12 GROUP BY k, license
)
SELECT doc_id, count(license) AS n_licenses, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses,
       round(max(containment), 6) AS containment
FROM d LEFT JOIN b ON d.k = b.k GROUP BY d.k, doc_id
""",
}
