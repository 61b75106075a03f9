"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .parameters import MIX, MIX_SEED
from .secret_scan import BASE, MORE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lines_sql(table: str) -> str:
    """doc_id, n_lines, n_dropped, text of the line dedup over ``table``."""
    return f"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {table})),
k AS (SELECT doc_id, i, line, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, k.i, k.line, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM f GROUP BY doc_id"""


LINES_SQL = f"SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({lines_sql('documents')})"


def _secrets_sql() -> str:
    ctes, unions = [], []
    for k, rule in enumerate((*BASE, *MORE)):
        pattern = rule.pattern if rule.kind != "hex" else "[0-9a-f]{16,}"
        pattern = pattern.replace("'", "''").replace('\\"', '"')
        ctes.append(f"""
s{k} AS (
  SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
         regexp_split_to_array(t, '{pattern}') AS p
  FROM d WHERE regexp_matches(t, '{pattern}')),
e{k} AS (
  SELECT doc_id, i, m, g, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM s{k}))""")
        unions.append(f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, a::BIGINT AS a, (a + length(m[i]))::BIGINT AS b FROM e{k} WHERE length(g[i]) >= {rule.least}")
    last = len(BASE)
    text = "kind || ':' || a || ':' || b"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{','.join(ctes)},
x AS ({' UNION ALL '.join(unions)})
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg({text}, ',' ORDER BY a, k) FILTER (k < {last}), '')) AS base_sha256,
  coalesce(string_agg({text}, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN x ON d.doc_id = x.doc_id GROUP BY d.doc_id"""


SECRETS_SQL = _secrets_sql()


def mix_sql(table: str, weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int, seed: int) -> str:
    """Rows doc_id, domain, lang, source, n_tokens, epoch of the mixture over ``table``."""
    levels = ["domain", "lang", "source"]

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.get(level, {}).items())
        return f"CASE {level} {cases} ELSE 1 END" if cases else "1"

    steps, above = [], "total"
    for depth in range(1, 4):
        path, parent = levels[:depth], levels[:depth - 1]
        by = f"PARTITION BY {', '.join([*parent, 'budget'])}"
        join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
        order = f"{by} ORDER BY cap / w, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        steps.append(f"""
n{depth} AS (SELECT *, {weight(path[-1])} AS w FROM (SELECT {', '.join(path)}, sum(tokens * {max_epochs})::BIGINT AS cap FROM leaf GROUP BY ALL) {join}),
o{depth} AS (SELECT *, coalesce(sum(cap) OVER ({order}), 0)::BIGINT AS cap_before,
  (sum(w) OVER ({by}) - coalesce(sum(w) OVER ({order}), 0))::BIGINT AS w_left FROM n{depth}),
p{depth} AS (SELECT *, cap * w_left <= (budget - cap_before) * w AS filled FROM o{depth}),
q{depth} AS (SELECT *, (sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({by}))::BIGINT AS spent,
  (sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({by}))::BIGINT AS w_open FROM p{depth}),
b{depth} AS (SELECT {', '.join(path)}, least(cap, CASE WHEN filled THEN cap ELSE (w * (budget - spent)) // w_open END) AS budget FROM q{depth})""")
        above = f"b{depth}"
    return f"""
WITH doc AS (
  SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    CASE WHEN regexp_extract(source, '([0-9]+)$', 1) = '' THEN 'other'
         ELSE 'd' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4) END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM {table}),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM doc GROUP BY ALL),
total AS (SELECT least(sum(tokens) * {max_epochs}, (sum(tokens) * {share[0]}) // {share[1]})::BIGINT AS budget FROM leaf),{','.join(steps)},
take AS (SELECT *, budget // tokens AS epochs, budget % tokens AS rest FROM leaf JOIN b3 USING (domain, lang, source)),
run AS (SELECT d.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{seed}:' || epochs || ':' || doc_id) ROWS UNBOUNDED PRECEDING) AS upto
  FROM doc d JOIN take USING (domain, lang, source)),
c AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM run)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, copies))::BIGINT AS epoch FROM c WHERE copies > 0"""


#: the weights, share, epochs and seed of the registered query
MIX_SQL = mix_sql("documents", MIX, (1, 2), 2, MIX_SEED)


#: CTE ``crc_table``: the 256 steps of CRC-32 (reflected polynomial) as one list t
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || list_transform(range(8), lambda x: 0::BIGINT),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32_sql(codes: str) -> str:
    """Unsigned CRC-32 of a list of byte values, with ``crc_table``'s t in scope."""
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def _merkle_sql() -> str:
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
                                       for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    up = """SELECT g, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM {0}
    WHERE n > 1 GROUP BY g, lvl, idx // 16, n"""
    return f"""
WITH RECURSIVE {CRC_TABLE},
h AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('low')} AS lowered,
    {crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 5 = 0 AS touched
  FROM (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS low FROM documents), crc_table),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM h),
low AS (SELECT g, 0 AS lvl, idx, n, leaf AS digest FROM l UNION ALL {up.format('low')}),
high AS (SELECT 0::BIGINT AS g, 0 AS lvl, g AS idx, (SELECT count(DISTINCT g) FROM l) AS n, digest FROM low WHERE n = 1
  UNION ALL {up.format('high')}),
runs AS (SELECT tree, g, lvl, idx // 16 AS run, list(digest ORDER BY idx) AS nodes
  FROM (SELECT 0 AS tree, * FROM low UNION ALL SELECT 1, * FROM high) WHERE n > 1 GROUP BY ALL),
f AS (
  SELECT doc_id, leaf, g AS home, 0 AS tree, g, 0 AS lvl, idx, n, CASE WHEN touched THEN lowered ELSE leaf END AS node, '' AS proof FROM l
  UNION ALL
  SELECT doc_id, leaf, home, CASE WHEN f.n = 1 THEN 1 ELSE f.tree END, CASE WHEN f.n = 1 THEN 0 ELSE f.g END,
    CASE WHEN f.n = 1 THEN 0 ELSE f.lvl + 1 END, CASE WHEN f.n = 1 THEN f.g ELSE f.idx // 16 END,
    CASE WHEN f.n = 1 THEN (SELECT count(DISTINCT g) FROM l) ELSE (f.n + 15) // 16 END,
    CASE WHEN f.n = 1 THEN node ELSE sha256(array_to_string(nodes[1:f.idx % 16], '') || node || array_to_string(nodes[f.idx % 16 + 2:], '')) END,
    CASE WHEN f.n = 1 THEN proof ELSE proof || array_to_string(nodes[1:f.idx % 16], '') || array_to_string(nodes[f.idx % 16 + 2:], '') END
  FROM f LEFT JOIN runs r ON r.tree = f.tree AND r.g = f.g AND r.lvl = f.lvl AND r.run = f.idx // 16 AND f.n > 1
  WHERE f.tree = 0 OR f.n > 1)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t.digest AS verified
FROM f JOIN low s ON s.g = f.home AND s.n = 1 JOIN high t ON t.n = 1 WHERE f.tree = 1 AND f.n = 1"""


MERKLE_SQL = _merkle_sql()
