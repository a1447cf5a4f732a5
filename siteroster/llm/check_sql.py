"""Check SQL, in DuckDB's dialect, that is too long to stand beside its query."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, a bit at a time: a byte is xored in, then eight shifts follow."""
    steps = (f"flatten(list_transform(regexp_extract_all({text}, '.'), lambda c: "
             "list_concat([CAST(ascii(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))")
    return (f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce(list_concat([4294967295], {steps}), lambda a, x: "
            "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) END")


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _tree(name: str, leaves: str, depth: int) -> str:
    """name_k: (tree, p, h, n) the nodes of level k; name_k_runs: (tree, p, kids, n) their runs of eight."""
    out = [f"{name}_0 AS (SELECT tree, p, h, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(depth):
        out.append(f"{name}_{k}_runs AS (SELECT tree, p // 8 AS p, list(h ORDER BY p) AS kids, any_value(n) AS n FROM {name}_{k} GROUP BY tree, p // 8)")
        out.append(f"{name}_{k + 1} AS (SELECT tree, p, CASE WHEN n > 1 THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS h, "
                   f"(n + 7) // 8 AS n FROM {name}_{k}_runs)")
    return ",\n".join(out)


def _up(name: str, source: str, depth: int, place: str, tree: str) -> str:
    """Join a row to the runs above it: what it proves and what it folds to, level by level."""
    out, now = [], source
    for k in range(depth):
        size = 8 ** k
        step = f"{name}_up{k}"
        slot = f"(({place} // {size}) % 8)"
        out.append(f"""{step} AS (SELECT x.* REPLACE (
  CASE WHEN r.n > 1 THEN x.proof || array_to_string(r.kids[1:{slot}], '') || array_to_string(r.kids[{slot} + 2:], '') ELSE x.proof END AS proof,
  CASE WHEN r.n > 1 THEN sha256(array_to_string(r.kids[1:{slot}], '') || x.folded || array_to_string(r.kids[{slot} + 2:], '')) ELSE x.folded END AS folded)
  FROM {now} x JOIN {name}_{k}_runs r ON r.tree = {tree} AND r.p = {place} // {8 * size})""")
        now = step
    return ",\n".join(out)


def merkle_manifest(depth: int = 7, root_depth: int = 3) -> str:
    """Good for 8^depth rows in a group and 8^root_depth groups."""
    plain = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = " || ".join(_field(lower if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    suspect = f"({crc32('CAST(doc_id AS VARCHAR)')}) % 3 = 0"
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce('v' || lang, 'n') AS tree, sha256({plain}) AS h, CASE WHEN {suspect} THEN sha256({changed}) ELSE sha256({plain}) END AS seen
  FROM documents),
g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM d),
{_tree("a", "g", depth)},
s AS MATERIALIZED (SELECT 'all' AS tree, tree AS grp, row_number() OVER (ORDER BY tree) - 1 AS p, h FROM a_{depth}),
{_tree("b", "s", root_depth)},
start AS (SELECT g.doc_id, g.tree, g.p, g.h, s.h AS subroot, s.p AS place, '' AS proof, g.seen AS folded FROM g JOIN s ON g.tree = s.grp),
{_up("a", "start", depth, "x.p", "x.tree")},
{_up("b", f"a_up{depth - 1}", root_depth, "x.place", "'all'")}
SELECT u.doc_id, u.h AS leaf, u.subroot, t.h AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = t.h AS verified
FROM b_up{root_depth - 1} u CROSS JOIN b_{root_depth} t"""


def prefix_trie() -> str:
    return f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
o AS (
  SELECT c.conv_id, 0 AS part, t.i, t.r, t.x FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth, r, x FROM o),
k AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, '' AS key, 0 AS bytes FROM c
  UNION ALL SELECT conv_id, depth, sha256(string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '')
    OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), strlen(x) FROM s),
m AS MATERIALIZED (SELECT conv_id, depth, bytes, min(conv_id) OVER (PARTITION BY depth, key) AS node, max(depth) OVER (PARTITION BY conv_id) AS length FROM k),
n AS MATERIALIZED (
  SELECT node AS conv_id, depth, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM m GROUP BY node, depth),
p AS (SELECT n.*, m.node AS parent_conv_id FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1),
f AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY 1, 2),
q AS (SELECT p.*, coalesce(f.n_children, 0) AS n_children FROM p LEFT JOIN f ON f.conv_id = p.conv_id AND f.depth = p.depth),
u AS (
  SELECT m.node AS conv_id, m.depth, count(*) FILTER (WHERE q.n_children = 0) AS n_leaves, sum((q.n_convs - 1) * q.bytes) AS saved_tokens
  FROM q JOIN m ON m.conv_id = q.conv_id AND m.depth <= q.depth GROUP BY m.node, m.depth)
SELECT q.conv_id, CAST(q.depth AS BIGINT) AS depth, q.parent_conv_id, q.n_convs, q.n_children, u.n_leaves,
  CAST(u.saved_tokens AS BIGINT) AS saved_tokens, q.ends_sha256
FROM q JOIN u ON u.conv_id = q.conv_id AND u.depth = q.depth"""
