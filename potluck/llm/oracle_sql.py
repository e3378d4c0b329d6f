"""DuckDB SQL for the operators that SQL can express."""

OP1 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM g JOIN f USING (s) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

# The steps of the distribution function are summed in the same order as in Spark.
OP4 = r"""
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n, power(CAST(count(*) AS DOUBLE), 0.7) AS weight FROM documents GROUP BY source),
rates AS (
  SELECT source, n, weight / (SELECT sum(weight) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
steps AS (
  SELECT source, rate, 0 AS k, CAST(0 AS DOUBLE) AS log_k, exp(-rate) AS step FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_k + ln(k + 1), step + exp((k + 1) * ln(rate) - rate - (log_k + ln(k + 1)))
  FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
tables AS (SELECT source, rate, list(step) AS steps FROM steps GROUP BY source, rate),
counted AS (
  SELECT d.doc_id, d.source, d.text, rate,
         len(list_filter(steps, lambda s: s <= CAST('0x' || substr(md5('mix-1|' || d.doc_id), 1, 13) AS BIGINT) / 4503599627370496.0)) AS copies
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
copied AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, CAST(copies AS INTEGER) AS copies, round(rate, 9) AS rate,
       CAST('0x' || substr(md5('mix-1|' || doc_id || '|' || copy), 1, 13) AS BIGINT) / 4503599627370496.0 AS order_key,
       sha256(text) AS text_sha256
FROM copied
"""

OP10 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e AS query_e, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, query_e ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

def crc32(text: str) -> str:
    """Unsigned crc32 of a text of code points up to U+00FF, bit by bit over its UTF-8 bytes."""
    octets = f"""flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)]
      ELSE [CAST(192 + (ord(c) >> 6) AS BIGINT), CAST(128 + (ord(c) & 63) AS BIGINT)] END))"""
    return f"""xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}),
      lambda a, b: list_reduce([xor(a, b), 1, 2, 3, 4, 5, 6, 7, 8],
                               lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


# Near words meet where both lack the code point at the same place, or the longer one any.
OP11 = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT run, count(*) AS c, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM r GROUP BY doc_id, run),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n
  FROM d GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3),
k AS (
  SELECT word, n, word[1:i - 1] || word[i + 1:] AS key, i FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
  UNION ALL SELECT word, n, word, 0 FROM w),
p AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b USING (key)
  WHERE a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS form, max(near_n) AS form_n, max(n) AS n FROM p GROUP BY word),
f AS (SELECT word, form, form_n FROM best WHERE form_n >= 2 * n),
walk AS (
  SELECT word, word AS root, 0 AS steps FROM w
  UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON f.word = walk.root),
ends AS (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word)
SELECT w.word, f.form, ends.root, w.n, coalesce(best.n_near, 0) AS n_near, f.form_n
FROM w LEFT JOIN best USING (word) LEFT JOIN f USING (word) JOIN ends USING (word)
"""


def _leaf(*values: str) -> str:
    """sha256 of fields; each value an expression."""
    return "sha256(" + " || ".join(
        f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || {v}, '-')" for v in values) + ")"


def _climb(name: str, levels: int) -> str:
    """Runs of eight, level by level, from ``{name}0`` (tree, idx, hash, n); ``{name}_top`` has
    what remains of each tree, ``{name}_run{k}`` the sides of each node of a run."""
    out = []
    for k in range(levels):
        out.append(f"""{name}_kids{k} AS (SELECT tree, idx // 8 AS parent, n, list(hash ORDER BY idx) AS kids FROM {name}{k} WHERE n > 1 GROUP BY ALL),
{name}_run{k} AS (SELECT tree, parent * 8 + i - 1 AS idx, array_to_string(kids[1:i - 1], '') AS l, array_to_string(kids[i + 1:], '') AS r
  FROM (SELECT *, unnest(range(1, len(kids) + 1)) AS i FROM {name}_kids{k})),
{name}{k + 1} AS (SELECT tree, parent AS idx, sha256(array_to_string(kids, '')) AS hash, (n + 7) // 8 AS n FROM {name}_kids{k}),""")
    tops = " UNION ALL ".join(f"SELECT tree, hash FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return "\n".join(out) + f"\n{name}_top AS ({tops}),"


def _walk(name: str, path: str, levels: int) -> str:
    """Each leaf's digests and proof carried up the levels of ``_climb``."""
    return "\n".join(f"""{path}{k + 1} AS (SELECT p.* REPLACE (p.idx // 8 AS idx, CASE WHEN r.idx IS NULL THEN seen ELSE sha256(l || seen || r) END AS seen,
  proof || coalesce(l || r, '') AS proof) FROM {path}{k} p LEFT JOIN {name}_run{k} r ON r.tree = p.tree AND r.idx = p.idx),""" for k in range(levels))


# Up to 8 ** 7 rows a language and 8 ** 4 languages.
OP13 = f"""
WITH d AS (
  SELECT *, {_leaf('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
         coalesce({crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0, false) AS touched,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
s AS (
  SELECT doc_id, leaf, g.tree, row_number() OVER (PARTITION BY g.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY g.tree) AS n,
         CASE WHEN touched THEN {_leaf('doc_id', 'source', 'd.lang', 'n_chars', 'lowered')} ELSE leaf END AS seen
  FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
a0 AS (SELECT tree, idx, leaf AS hash, n FROM s),
{_climb('a', 7)}
b0 AS (SELECT 0 AS tree, tree AS idx, hash, (SELECT count(*) FROM g) AS n FROM a_top),
{_climb('b', 4)}
p0 AS (SELECT doc_id, leaf, tree, idx, seen, '' AS proof FROM s),
{_walk('a', 'p', 7)}
q0 AS (SELECT doc_id, leaf, tree AS of, 0 AS tree, tree AS idx, seen, proof FROM p7),
{_walk('b', 'q', 4)}
result AS (
  SELECT doc_id, leaf, a_top.hash AS subroot, b_top.hash AS root, sha256(proof) AS proof_sha256, seen AS folded_root
  FROM q4 JOIN a_top ON a_top.tree = q4.of CROSS JOIN b_top)
SELECT *, folded_root = root AS verified FROM result
"""

QUERIES: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op4_poisson_mix": OP4,
    "op10_topk_search": OP10,
    "op11_spelling_groups": OP11,
    "op13_merkle_manifest": OP13,
}
