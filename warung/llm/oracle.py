"""DuckDB SQL of the queries that SQL can express over whole tables."""

SQL: dict[str, str] = {}

SQL["op4_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

SQL["op9_url_filters"] = r"""
WITH u AS (SELECT page_id,
                  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
           FROM pages),
     r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
                                 ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'),
                                 ('net', '/fr/', 'block')) AS t(h, p, v)),
     m AS (SELECT page_id, h || p AS rule, v,
                  row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
           FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1
"""

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# CRC-32 of a string's UTF-8 bytes, from the table of its 256 one-byte steps
CRC_TABLE = """crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
               FROM range(256) r(b))"""


def crc32(s: str) -> str:
    byte = f"CAST('0x' || substr(hex({s}), 2 * i + 1, 2) AS BIGINT)"
    return (f"xor(4294967295, list_reduce(list_transform(range(strlen({s})), lambda i: {byte}), "
            "lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295))")


def _sized(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sized(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf("text")} AS leaf,
             CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(f"translate(text, {AZ})")} END AS other
      FROM documents, crc_table),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
low AS (SELECT tree, 0 AS lvl, idx, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM l
        UNION ALL
        SELECT tree, lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (n + 7) // 8
        FROM low WHERE n > 1 GROUP BY tree, lvl, idx // 8, n),
sub AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx FROM low WHERE n = 1),
top AS (SELECT 0 AS lvl, idx, subroot AS node, count(*) OVER () AS n FROM sub
        UNION ALL
        SELECT lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, idx // 8, n),
-- a leaf's levels in its own tree and above it: level, place, nodes of its run
height AS (SELECT tree, max(lvl) AS h FROM low GROUP BY tree),
runs AS (SELECT tree, lvl, idx // 8 AS run, list(node ORDER BY idx) AS nodes FROM low WHERE n > 1 GROUP BY tree, lvl, idx // 8),
topruns AS (SELECT lvl, idx // 8 AS run, list(node ORDER BY idx) AS nodes FROM top WHERE n > 1 GROUP BY lvl, idx // 8),
steps AS (SELECT l.tree, l.idx, r.lvl, (l.idx // (8 ** r.lvl)::BIGINT) % 8 AS place, r.nodes
          FROM l JOIN runs r ON r.tree = l.tree AND r.run = l.idx // (8 ** (r.lvl + 1))::BIGINT
          UNION ALL
          SELECT l.tree, l.idx, h + t.lvl, (s.idx // (8 ** t.lvl)::BIGINT) % 8, t.nodes
          FROM l JOIN height USING (tree) JOIN sub s USING (tree) JOIN topruns t ON t.run = s.idx // (8 ** (t.lvl + 1))::BIGINT),
proofs AS (SELECT tree, idx, sha256(coalesce(string_agg(array_to_string(nodes[:place] || nodes[place + 2:], ''), '' ORDER BY lvl), '')) AS proof
           FROM steps GROUP BY tree, idx),
folded AS (SELECT tree, idx, 0 AS lvl, coalesce(other, leaf) AS node FROM l
           UNION ALL
           SELECT f.tree, f.idx, f.lvl + 1, sha256(array_to_string(s.nodes[:s.place] || [f.node] || s.nodes[s.place + 2:], ''))
           FROM folded f JOIN steps s ON s.tree = f.tree AND s.idx = f.idx AND s.lvl = f.lvl),
ends AS (SELECT tree, idx, max_by(node, lvl) AS folded_root FROM folded GROUP BY tree, idx)
SELECT l.doc_id, l.leaf, s.subroot, t.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.node AS verified
FROM l JOIN sub s USING (tree) JOIN ends e ON e.tree = l.tree AND e.idx = l.idx
     LEFT JOIN proofs p ON p.tree = l.tree AND p.idx = l.idx, (SELECT node FROM top WHERE n = 1) t
"""

SQL["op12_decontamination"] = f"""
WITH i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[pos:pos + 9], ' ') AS gram, 10 AS size FROM i, unnest(range(1, len(w) - 8)) u(pos) WHERE len(w) >= 10
      UNION ALL
      SELECT DISTINCT item_id, array_to_string(w, ' '), len(w) FROM i WHERE len(w) BETWEEN 1 AND 9),
d AS (SELECT doc_id, row_number() OVER () AS rid, {WORDS} AS w FROM documents),
c AS (SELECT rid, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS gram
      FROM d, (SELECT DISTINCT size FROM g), unnest(range(1, len(w) - size + 2)) u(pos)),
h AS (SELECT rid, pos, size, item_id FROM c JOIN g USING (gram, size)),
n AS (SELECT rid, count(DISTINCT pos + k) AS n_hit FROM h, unnest(range(size)) u(k) GROUP BY rid),
e AS (SELECT rid, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items
      FROM h WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN e USING (rid)
"""

SQL["op13_importance_resampling"] = f"""
WITH {CRC_TABLE},
w AS (SELECT 0 AS kind, doc_id, row_number() OVER () AS rid, {WORDS} AS w FROM documents
      UNION ALL SELECT 1, NULL, row_number() OVER (), {WORDS} FROM benchmark),
f AS (SELECT kind, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS feature FROM w),
b AS (SELECT feature, {crc32("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f), crc_table),
n AS (SELECT kind, rid, bucket FROM f JOIN b USING (feature)),
k AS (SELECT bucket, CAST(sum(1 - kind) AS DOUBLE) AS s, CAST(sum(kind) AS DOUBLE) AS t FROM n GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM k),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM k, a),
doc AS (SELECT rid, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM n JOIN gain USING (bucket) WHERE kind = 0 GROUP BY rid),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
                                                                   / 4294967296.0))) AS BIGINT) AS score
           FROM w LEFT JOIN doc USING (rid) WHERE kind = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
             count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM r
"""
