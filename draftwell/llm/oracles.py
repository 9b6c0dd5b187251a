"""SQL twins (DuckDB) of the operators that SQL can express at all."""

from __future__ import annotations

from .chat import CONTROL, PROBE
from .collocations import ORACLE as COLLOCATIONS
from .decontaminate import MASKS, MIN_ITEM, SPAN, WINDOW
from .exact_dedup import ORACLE as EXACT
from .spelling import ORACLE as SPELLING
from .substring_dedup import LENGTH
from .topk import ORACLE as TOP_K

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _seeds(of: str, key: str) -> str:
    parts = [f"SELECT {key}, p AS pos, '{i}|' || " + " || ' ' || ".join(f"w[p + {o + 1}]" for o in mask) + f" AS seed FROM (SELECT *, unnest(range(0, len(w) - {mask[-1]})) AS p FROM {of})" for i, mask in enumerate(MASKS)]
    parts += [f"SELECT {key}, p AS pos, 'w{k}|' || array_to_string(w[p + 1 : p + {k}], ' ') AS seed FROM (SELECT *, unnest(range(0, len(w) - {k - 1})) AS p FROM {of})" for k in range(MIN_ITEM, SPAN)]
    return " UNION ALL ".join(parts)


CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= {MIN_ITEM}),
ds AS ({_seeds("d", "row")}),
bs AS (SELECT s.* FROM ({_seeds("b", "item, len(w) AS n")}) s WHERE CASE WHEN n < {SPAN} THEN starts_with(seed, 'w' || n || '|') ELSE NOT starts_with(seed, 'w') END),
lined AS (SELECT DISTINCT ds.row, bs.item, ds.pos - bs.pos AS diag FROM ds JOIN bs USING (seed)),
m AS (SELECT d.doc_id, d.row, b.item_id, l.diag, len(b.w) AS n, list_transform(range(0, len(b.w)), lambda j: CASE WHEN l.diag + j >= 0 AND d.w[l.diag + j + 1] = b.w[j + 1] THEN 1 ELSE 0 END) AS hit FROM lined l JOIN d USING (row) JOIN b USING (item)),
best AS (SELECT *, list_sum(hit) AS matched, list_max(list_transform(range(0, n - least(n, {WINDOW}) + 1), lambda s: list_sum(hit[s + 1 : s + least(n, {WINDOW})]))) AS top FROM m)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_tokens, CAST(max(matched) AS INTEGER) AS matched_tokens, max(matched) / n AS overlap, CAST(arg_min(diag, [-matched, diag]) AS INTEGER) AS doc_start
FROM best WHERE top * 5 >= least(n, {WINDOW}) * 4 GROUP BY doc_id, row, item_id, n
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, b, unnest(range(0, n - {LENGTH - 1})) AS pos FROM d),
w AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY md5(b[pos + 1 : pos + {LENGTH}]) ORDER BY doc_id, pos) > 1 AS again FROM p),
r AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM w WHERE again),
s AS (SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM r),
spans AS (SELECT doc_id, span, min(pos) AS a, max(pos) + {LENGTH} AS z FROM s GROUP BY doc_id, span),
cuts AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM spans),
kept AS (SELECT c.doc_id, sum(z - a) AS removed, count(*) AS n_spans, string_agg(hex(d.b[last + 1 : a]) || CASE WHEN final THEN hex(d.b[z + 1 :]) ELSE '' END, '' ORDER BY a) AS h FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_PATTERN = "|".join("".join("\\" + c if c in "[]/" else c for c in s) for s in CONTROL)

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, length(replace(text, '\\', '\\\\')) + len(regexp_extract_all(replace(text, '\\', '\\\\'), '{_PATTERN}'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 17 + length(replace(role, '\\', '\\\\')) + len(regexp_extract_all(replace(role, '\\', '\\\\'), '{_PATTERN}')) END AS written FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(written) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

ORACLES = {
    "op1_decontaminate": CONTAMINATION, "op3_exact_dedup": EXACT, "op4_substring_dedup": SUBSTRINGS, "op7_chat": CHAT,
    "op11_spelling": SPELLING, "op12_collocations": COLLOCATIONS, "op13_top_k": TOP_K,
}
