"""SQL, as DuckDB speaks it, with the rows of the operators that SQL can express."""

from __future__ import annotations

from tablewright.llm import merkle_strings as k
from tablewright.llm import pfair as m
from tablewright.llm import url_terms as u

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(list) AS line, unnest(range(len(list))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents)
), keyed AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _hits(terms: tuple[str, ...]) -> str:
    tests = (f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INTEGER" for t in terms)
    return "(" + " + ".join(tests) + ")"


def url_terms() -> str:
    """The rules as one CASE, the longest first, and a regular expression for each term."""
    rules = sorted(u.RULES, key=lambda r: (-len(r.name), -len(r.host)))
    fits = [
        (f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in rules
    ]
    names = " ".join(f"WHEN {test} THEN '{r.name}'" for test, r in fits)
    verdicts = " ".join(f"WHEN {test} THEN '{r.verdict}'" for test, r in fits)
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url,
         CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, {_LOWER.format("url")} AS low, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), hits AS (SELECT *, {_hits(u.STRICT)} AS n_strict, {_hits(u.SOFT)} AS n_soft FROM parts)
SELECT page_id, host, path, n_strict::INTEGER AS n_strict, n_soft::INTEGER AS n_soft,
       CASE {names} END AS rule,
       CASE {verdicts} WHEN n_strict > 0 OR n_soft >= {u.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict
FROM hits
"""


def _pfair() -> str:
    """Earliest deadline first, slot by slot, until every class has all its blocks; the others take turns."""
    names = sorted(m.WEIGHTS)
    shares = [*[m.WEIGHTS[n] for n in names], m.OTHER_WEIGHT]
    total = sum(shares)
    classes = ", ".join(f"({k}, {w})" for k, w in enumerate(shares))
    which = " ".join(f"WHEN kind = '={n}' THEN {k}" for k, n in enumerate(names))
    return f"""
WITH RECURSIVE classes(k, w) AS (VALUES {classes}), sources AS (
  SELECT kind, k, CASE WHEN k < {len(names)} THEN 0 ELSE row_number() OVER (PARTITION BY k ORDER BY kind) - 1 END AS turn,
         CASE WHEN k < {len(names)} THEN 1 ELSE count(*) OVER (PARTITION BY k) END AS members
  FROM (SELECT kind, CASE {which} ELSE {len(names)} END AS k FROM (SELECT DISTINCT coalesce('=' || source, '') AS kind FROM documents))
), ranked AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS kind,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS n
  FROM documents
), blocks AS (
  SELECT doc_id, source, k, w, members, n, n // {m.BLOCK} AS b, n // {m.BLOCK} * members + turn AS i
  FROM ranked JOIN sources USING (kind) JOIN classes USING (k)
), bounds AS (SELECT max((i // w + 1) * {total}) AS horizon FROM blocks
), slots(t, k, i, done) AS (
  SELECT 0, -1, 0, list_transform(range({len(shares)}), lambda x: 0)
  UNION ALL
  SELECT t + 1, best, done[best + 1], list_transform(range({len(shares)}), lambda x: done[x + 1] + (x = best)::INTEGER)
  FROM (
    SELECT t, done, (
      SELECT c.k FROM classes c WHERE done[c.k + 1] * {total} // c.w <= t
      ORDER BY ((done[c.k + 1] + 1) * {total} + c.w - 1) // c.w, c.k LIMIT 1
    ) AS best
    FROM slots WHERE t < (SELECT horizon FROM bounds)
  )
)
SELECT doc_id, source, (w / {total}.0)::DOUBLE / members AS share, b::BIGINT AS block, (b * {total} * members // w)::BIGINT AS release,
       (((b + 1) * {total} * members + w - 1) // w)::BIGINT AS deadline, (t - 1)::BIGINT AS slot,
       (row_number() OVER (ORDER BY t, n) - 1)::BIGINT AS position
FROM blocks JOIN slots ON slots.k = blocks.k AND slots.i = blocks.i
"""


PFAIR = _pfair()

_FINITE = """
  SELECT * FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
"""

TOP_PRODUCTS = f"""
WITH used AS ({_FINITE}), whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM used WHERE vec_id IS NOT NULL
), scored AS (
  SELECT q.vec_id AS query_id, k.vec_id, list_dot_product(q.v, k.v)::BIGINT AS score
  FROM whole q JOIN whole k ON q.vec_id % 50 = 0 AND k.vec_id <> q.vec_id AND len(k.v) = len(q.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

NEAR_VECTORS = f"""
WITH RECURSIVE used AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM ({_FINITE})
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM used a JOIN used b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), components AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts USING (vec_id)
"""


def _crc32(text: str) -> str:
    """Bit by bit over the bytes of a text of digits."""
    bits = "list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, b))"
    read = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce({read}, lambda crc, b: {bits}, 4294967295), 4294967295)"


def _leaf(fields: tuple[str, ...]) -> str:
    parts = (f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields)
    return f"sha256({' || '.join(parts)})"


def _levels(name: str, leaves: str) -> str:
    """All levels of trees, and for each node what stands left and right of it in its run."""
    return f"""
{name}(level, tree, pos, node, total) AS (
  SELECT 0, tree, pos, node, total FROM {leaves}
  UNION ALL
  SELECT level + 1, tree, pos // {k.ARITY}, sha256(string_agg(node, '' ORDER BY pos)), (total + {k.ARITY - 1}) // {k.ARITY}
  FROM {name} WHERE total > 1 GROUP BY level, tree, pos // {k.ARITY}, total
), {name}_steps AS (
  SELECT level, tree, pos, coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE total > 1 WINDOW run AS (PARTITION BY level, tree, pos // {k.ARITY} ORDER BY pos)
)"""


def _folded(name: str, starts: str, levels: str) -> str:
    return f"""
{name}(doc_id, seq, level, tree, pos, node, proof) AS (
  SELECT doc_id, seq, 0, tree, pos, node, proof FROM {starts}
  UNION ALL
  SELECT doc_id, seq, f.level + 1, f.tree, f.pos // {k.ARITY}, sha256(s.l || node || s.r), proof || s.l || s.r
  FROM {name} f JOIN {levels}_steps s ON s.level = f.level AND s.tree = f.tree AND s.pos = f.pos
), {name}_top AS (SELECT doc_id, seq, arg_max(node, level) AS node, arg_max(proof, level) AS proof, any_value(tree) AS tree FROM {name} GROUP BY doc_id, seq)"""


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf(k.FIELDS)} AS node,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf((*k.FIELDS[:-1], _LOWER.format("text")))} END AS changed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS total, row_number() OVER () AS seq
  FROM leaves
), {_levels("trees", "placed")}, subroots AS (
  SELECT tree AS own, node, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total
  FROM trees WHERE total = 1
), {_levels("forest", "subroots")}, starts AS (
  SELECT doc_id, seq, tree, pos, coalesce(changed, node) AS node, '' AS proof FROM placed
), {_folded("climb", "starts", "trees")}, higher AS (
  SELECT c.doc_id, seq, '' AS tree, s.pos, c.node, c.proof FROM climb_top c JOIN subroots s ON s.own = c.tree
), {_folded("finish", "higher", "forest")}
SELECT p.doc_id, p.node AS leaf, s.node AS subroot, r.node AS root, sha256(f.proof) AS proof_sha256,
       f.node AS folded_root, f.node = r.node AS verified
FROM placed p JOIN subroots s ON s.own = p.tree JOIN finish_top f ON f.seq = p.seq
JOIN forest r ON r.total = 1
"""
