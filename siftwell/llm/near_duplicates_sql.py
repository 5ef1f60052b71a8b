"""SQL of the near-duplicate components: all pairs of sets that share a shingle, and the smallest id reached."""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT r, doc_id,
         CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w),
e AS (SELECT r, unnest(s) AS g FROM s),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (
  SELECT sx.doc_id AS a, sy.doc_id AS b FROM p JOIN s sx ON x = sx.r JOIN s sy ON y = sy.r
  WHERE 100 * c >= 80 * (len(sx.s) + len(sy.s) - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT reach.doc_id, u.b FROM reach JOIN u ON reach.c = u.a),
m AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)"""
