"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# ASCII-only lower case; DuckDB's lower() also maps other letters.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op10_decontaminate"] = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT cast(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM item_windows
), hits AS (
  SELECT doc_id, i, o.n, item
  FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
        FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)) o
  JOIN item_windows USING (n, win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

_SIZES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}

ORACLE["op6_quality_rules"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, length(unnest(w)) AS chars FROM d WHERE len(w) > 0
), grams AS (
  SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, g) AS times,
         row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS nth
  FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM d, (SELECT unnest([{', '.join(map(str, _SIZES))}]) AS n) WHERE len(w) >= n))
), repeats AS (
  SELECT doc_id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM grams WHERE n = 8 AND times > 1) GROUP BY doc_id
), covered AS (
  SELECT doc_id, n, sum(chars) AS c
  FROM (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS p FROM grams WHERE nth > 1) JOIN words USING (doc_id, p)
  GROUP BY doc_id, n
), totals AS (SELECT doc_id, sum(chars) AS word_chars FROM words GROUP BY doc_id
), high AS (
  SELECT DISTINCT doc_id FROM covered JOIN totals USING (doc_id)
  WHERE {' OR '.join(f'(n = {n} AND c::DOUBLE / word_chars > {x})' for n, x in _SIZES.items())}
), lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), line_sums AS (
  SELECT doc_id, count(*) AS n_lines, sum((nth > 1)::INT) AS n_dup, sum(length(line)) AS c,
         coalesce(sum(length(line)) FILTER (nth > 1), 0) AS dup_c
  FROM lines GROUP BY doc_id
), base AS (
  SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
         cast(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         cast(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
         cast(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed,
         coalesce(dup_c::DOUBLE / c, 0) > 0.20 OR coalesce(n_dup::DOUBLE / n_lines, 0) > 0.30
           OR high.doc_id IS NOT NULL AS bad
  FROM d LEFT JOIN totals USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN line_sums USING (doc_id)
  LEFT JOIN high USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (bad OR base_failed) AS kept
FROM base
"""

_RATIO = "ORDER BY cap / nullif(weight, 0) NULLS FIRST, cap, weight"

ORACLE["op2_mix_sources"] = f"""
WITH d AS (
  SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT AS draw
  FROM documents
), s AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size,
         [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 3::DOUBLE AS cap, cast(sum(source_size) OVER () AS DOUBLE) AS total FROM s
), w AS (
  SELECT *, cap * sum(weight) OVER ({_RATIO} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= weight * (total
            - coalesce(sum(cap) OVER ({_RATIO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS clamped
  FROM c
), t AS (
  SELECT source, source_size, clamped, CASE WHEN clamped THEN cap ELSE weight
         * ((total - coalesce(sum(cap) FILTER (clamped) OVER (), 0)) / (sum(weight) FILTER (NOT clamped) OVER ())) END AS target
  FROM w
), p AS (
  SELECT *, cast(CASE WHEN clamped THEN 3 ELSE coalesce(floor(target / nullif(source_size, 0)), 0) END AS BIGINT) AS whole FROM t
), x AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS want,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, cast(size * (whole + (want > 0 AND (upto < want
       OR (upto - size < want AND 2 * (want - (upto - size)) >= size)))::INT) AS BIGINT) AS taken
FROM x
"""

ORACLE["op7_jaccard_join"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (g) GROUP BY ALL
), links AS (
  SELECT x, y, c = nx.n AND c = ny.n AS same
  FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.node
), comp AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id
), class AS (SELECT x AS doc_id, min(y) AS class_id FROM links WHERE same GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(class_id, d.doc_id) AS class_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id) LEFT JOIN class USING (doc_id)
"""

# crc32 of an ASCII string column ``k`` by its usual table; ``tab`` is the table's column.
_CRC_TABLE = ("list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda x, y: "
              "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))")
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)), "
        "lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295)")


def _then(label: str, cost: str, edit: str) -> str:
    """A label (cost, audit) with one more edit; no label stays none."""
    return f"CASE WHEN {label} IS NOT NULL THEN {{'c': {label}.c + {cost}, 'a': {label}.a || '{edit}'}} END"


def _when(condition: str, label: str) -> str:
    return f"CASE WHEN {condition} THEN {label} END"


# Labels of the states nothing, system, user, assistant after a row: Delete, Keep and Rerole ...
_ROW_EDITS = {
    "p0": [_then("s0", "2", "D")],
    "p1": [_then("s1", "2", "D"), _when("fault < 2 AND initial = 's'", _then("s0", "5 * fault", "K"))],
    "p2": [_then("s2", "2", "D"),
           *[_when("fault < 2 AND initial = 'u'", _then(s, "5 * fault", "K")) for s in ("s0", "s1", "s3")],
           *[_when("fault < 2", _then(s, "5 * fault + 1", "R")) for s in ("s0", "s1", "s3")]],
    "p3": [_then("s3", "2", "D"), _when("fault < 2 AND initial = 'a'", _then("s2", "5 * fault", "K")),
           _when("fault < 2", _then("s2", "5 * fault + 1", "R"))],
}
_ROW_LABELS = ", ".join(f"least({', '.join(x)}, NULL) AS {p}" for p, x in _ROW_EDITS.items())
# ... and then Insert; two in a row suffice, more would lead back to the same state.
_AFTER_INSERT = ", ".join(["p0 AS s0", "p1 AS s1", "i2 AS s2", f"least(p3, {_then('i2', '5', 'I')}) AS s3"])
_INSERT_USER = f"least(p2, {', '.join(_then(p, '5', 'I') for p in ('p0', 'p1', 'p3'))}) AS i2"

ORACLE["op12_repair_conversations"] = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind
  FROM (SELECT *, coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' ') AS k, tab
        FROM conversations, (SELECT {_CRC_TABLE} AS tab))
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq,
         substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended
  FROM damaged
), faults AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY seq) AS earlier,
         CASE WHEN ended = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY seq) > 1 THEN 'd'
              WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS kind
  FROM numbered
), steps AS (
  SELECT conv_id, seq, initial, CASE kind WHEN '' THEN 0 WHEN 't' THEN 1 ELSE 2 END AS fault FROM faults
), walk AS (
  SELECT conv_id, 0::BIGINT AS seq, {{'c': 0::BIGINT, 'a': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR) AS s1,
         {{'c': 5::BIGINT, 'a': 'I'}} AS s2, {{'c': 10::BIGINT, 'a': 'II'}} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, seq, {_AFTER_INSERT}
  FROM (SELECT *, {_INSERT_USER}
        FROM (SELECT w.conv_id, t.seq, {_ROW_LABELS}
              FROM walk w JOIN steps t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.seq = w.seq + 1))
), audits AS (
  SELECT conv_id, seq AS n, least(s0, s3) AS best FROM walk
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) = 1
), edits AS (
  SELECT conv_id, edit, p, count(*) FILTER (edit <> 'I') OVER upto AS seq, count(*) FILTER (edit <> 'D') OVER upto AS place
  FROM (SELECT conv_id, unnest(string_split(best.a, '')) AS edit, unnest(range(1, length(best.a) + 1)) AS p
        FROM audits WHERE best.a <> '')
  WINDOW upto AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)
), kept AS (
  SELECT e.conv_id, e.edit, e.place, f.role, f.text,
         max(CASE WHEN e.place = 1 AND e.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS lead
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.seq = e.seq AND e.edit <> 'I'
  WHERE e.edit <> 'D'
), texts AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                    || ':' || coalesce(text, ''), chr(10) ORDER BY place)) AS digest
  FROM kept GROUP BY conv_id
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate,
         count(*) FILTER (kind = 't') AS truncated,
         count(*) FILTER (seq > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT a.conv_id, cast(coalesce(f.gaps, 0) AS BIGINT) AS gaps, coalesce(f.blank, 0) AS blank,
       coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
       a.best.c AS cost, a.best.a AS audit, coalesce(t.digest, sha256('')) AS repaired_sha256
FROM audits a LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLE["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same,
         cast(list_inner_product(cast(a.q AS DOUBLE[]), cast(v.q AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a, v
  WHERE a.vec_id <> v.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, cast(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score,
       s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10
"""
