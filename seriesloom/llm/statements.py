"""DuckDB SQL of queries whose statement is long."""

from __future__ import annotations

CRC = """bits AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab
      FROM range(256) AS r(i))"""


def crc(x: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; needs the table `bits` beside it."""
    return f"""xor(list_reduce(list_transform(regexp_extract_all(hex({x}), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"""

OP11 = f"""
    WITH RECURSIVE {CRC},
    d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size,
      ('0x' || substr(md5('i' || doc_id), 1, 8))::BIGINT % 4096 AS v FROM documents),
    v AS (SELECT v, sum(size)::BIGINT AS b, v % 16 AS s FROM d GROUP BY v),
    k AS (SELECT *, row_number() OVER w AS i, sum(b) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM v
      WINDOW w AS (PARTITION BY s ORDER BY b DESC, v)),
    kept AS (SELECT v, s, b FROM k WHERE i = 1 OR run <= (SELECT sum(b) / 16 FROM v)),
    free AS (SELECT v, b, row_number() OVER (ORDER BY b DESC, v) AS i FROM v WHERE v NOT IN (SELECT v FROM kept)),
    start AS (SELECT list(coalesce(b, 0)::BIGINT ORDER BY s) AS l FROM range(16) AS r(s) LEFT JOIN (SELECT s, sum(b) AS b FROM kept GROUP BY s) USING (s)),
    deal(i, l, s, v) AS (
      SELECT 0::BIGINT, l, 0::BIGINT, -1::BIGINT FROM start
      UNION ALL
      SELECT f.i, list_transform(l, lambda x, j: CASE WHEN j = list_position(l, list_min(l)) THEN x + f.b ELSE x END),
        list_position(l, list_min(l)) - 1, f.v
      FROM deal JOIN free f ON f.i = deal.i + 1),
    m AS (SELECT v, s FROM kept UNION ALL SELECT v, s FROM deal WHERE i > 0)
    SELECT doc_id, size::BIGINT AS size, {crc('text')}::BIGINT AS text_crc32, 'bytes' AS law, s::INT AS shard,
      row_number() OVER (PARTITION BY s ORDER BY v, doc_id) - 1 AS slot, NULL::INT AS grown_shard, v AS virtual_slot
    FROM d JOIN m USING (v), bits
    """
OP12 = f"""
    WITH {CRC},
    t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i,
      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT c, c - c % 100 AS host, {crc('c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c FROM t), bits),
    n AS (SELECT c AS host, count(*) AS n FROM t GROUP BY c),
    r AS (SELECT ids.c, t.i, role, text FROM ids JOIN t ON t.c = ids.host AND t.i < h
      UNION ALL SELECT c, i - h + least(h, coalesce(n, 0)), role, text FROM t JOIN ids USING (c) LEFT JOIN n USING (host) WHERE i >= h),
    p AS (SELECT c, 0::BIGINT AS d, [] AS k, '' AS x FROM ids UNION ALL
      SELECT c, i + 1, list(sha256(strlen(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY i), text FROM r),
    q AS (SELECT c, d, sha256(k::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(list_slice(k, 1, len(k) - 1)::VARCHAR) END AS up, x,
      d = max(d) OVER (PARTITION BY c) AS stop FROM p),
    g AS (SELECT d, k, min(c) AS c, any_value(up) AS up, count(*) AS n, any_value(length(x)) AS len,
      coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE stop), '') AS ends FROM q GROUP BY d, k),
    kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL),
    f AS (SELECT g.*, coalesce(kids.n, 0) AS n_children FROM g LEFT JOIN kids USING (d, k)),
    s AS (SELECT a.d, a.k, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n - 1) * f.len) AS saved
      FROM f JOIN q a ON a.c = f.c AND a.d <= f.d GROUP BY a.d, a.k)
    SELECT f.c AS conv_id, f.d AS depth, o.c AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
      s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
    FROM f JOIN s USING (d, k) LEFT JOIN g o ON o.d = f.d - 1 AND o.k = f.up
    """
ROUND = """
    a{i} AS MATERIALIZED (SELECT id, arg_min(j, (dist, j)) AS j FROM (
      SELECT v.id, c.j, sum((v.x - c.x) * (v.x - c.x)) AS dist FROM x v JOIN c{i} c USING (d) GROUP BY v.id, c.j) GROUP BY id),
    c{n} AS MATERIALIZED (SELECT c.j, c.d, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
      SELECT a.j, v.d, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM x v JOIN a{i} a USING (id) GROUP BY a.j, v.d) m USING (j, d)),"""
OP13 = """
    WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    x AS MATERIALIZED (SELECT id, d, floor(256 * v[d]::DOUBLE)::BIGINT AS x FROM e, range(1, 65) AS r(d)),
    c0 AS MATERIALIZED (SELECT j, d, x FROM x JOIN (SELECT id, row_number() OVER (ORDER BY sha256('2:' || id)) - 1 AS j FROM e
      QUALIFY row_number() OVER (ORDER BY sha256('2:' || id)) <= 40) USING (id)),""" + "".join(ROUND.format(i=i, n=i + 1) for i in range(5)) + """
    f AS MATERIALIZED (SELECT id, arg_min(j, (dist, j)) AS j, min(dist) AS dist FROM (
      SELECT v.id, c.j, sum((v.x - c.x) * (v.x - c.x)) AS dist FROM x v JOIN c5 c USING (d) GROUP BY v.id, c.j) GROUP BY id),
    h AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS sha FROM c5 GROUP BY j)
    SELECT id AS vec_id, j::INT AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY j))::BIGINT AS cluster_inertia,
      (sum(dist) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
    FROM f JOIN h USING (j)
    """
