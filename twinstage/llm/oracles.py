"""DuckDB twins of the operators that SQL can express, written independently of them.

They are for small tables: the twin of the near-duplicate operators joins all pairs that
share anything, that of the repeated strings keeps every string of 50 bytes.
"""

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

REPEATS = """
WITH d AS (SELECT doc_id, encode(COALESCE(text, '')) AS b FROM documents),
g AS (SELECT doc_id, p, b[p:p + 49] AS s FROM d, range(1, octet_length(b) - 48) r(p)),
f AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s),
m AS (SELECT g.doc_id, g.p FROM g JOIN f ON f.s = g.s WHERE f.low < g.doc_id),
j AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM m),
k AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM j),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 49 AS z FROM k GROUP BY doc_id, run),
edge AS (SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) FROM d),
piece AS (SELECT doc_id, a, COALESCE(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z), 0) + 1 AS from_, a - 1 AS to_ FROM edge),
kept AS (SELECT piece.doc_id, string_agg(CASE WHEN to_ >= from_ THEN hex(b[from_:to_]) ELSE '' END, '' ORDER BY a) AS h
         FROM piece JOIN d ON d.doc_id = piece.doc_id GROUP BY piece.doc_id),
c AS (SELECT doc_id, sum(z - a + 1) AS n, count(*) AS r FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(COALESCE(c.n, 0) AS BIGINT) AS n_removed,
       CAST(COALESCE(c.r, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
      FROM w, range(1, greatest(len(w), 2)) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pairs AS (SELECT x, y FROM meet JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
low AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, low.c AS component_id, d.doc_id = low.c AS kept
FROM documents d JOIN low ON low.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
low AS (SELECT x, min(y) AS c FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_links, low.c AS component_id, e.vec_id = low.c AS kept
FROM embeddings e JOIN low ON low.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id"""

HARD_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS s
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
r AS (SELECT a, b, s, CAST(row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS INTEGER) AS positive_rank FROM p),
n AS (SELECT r.a, r.b, r.s AS ps, r.positive_rank, s.b AS c, s.s AS ns, row_number() OVER (PARTITION BY r.a, r.b ORDER BY s.s DESC, s.b) AS k
      FROM r JOIN s ON s.a = r.a AND NOT s.same AND 50 * r.s <= 100 * s.s AND 100 * s.s <= 95 * r.s)
SELECT a AS anchor_id, b AS positive_id, CAST(k AS INTEGER) AS rank, c AS negative_id, ps AS positive_score, ns AS negative_score, positive_rank
FROM n WHERE k <= 3"""
