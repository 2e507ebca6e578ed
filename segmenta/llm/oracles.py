"""DuckDB SQL of the same results, for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM s),
c AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
        coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (ORDER BY 2 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM w),
v AS (SELECT *, max((total - before::DOUBLE) / left_weight::DOUBLE) OVER () AS level FROM c),
t AS (SELECT *, least(level * weight, (2 * source_size)::DOUBLE) AS target FROM v),
e AS (SELECT *, round(target)::BIGINT AS stop FROM t),
f AS (SELECT *, sum(stop) OVER ()::BIGINT AS all_end, sum(stop) OVER (ORDER BY place)::BIGINT AS hi_end FROM e),
p AS (SELECT *, floor((hi_end - stop)::DOUBLE / all_end * 4294967296)::BIGINT AS lo, floor(hi_end::DOUBLE / all_end * 4294967296)::BIGINT AS hi FROM f),
b AS (SELECT greatest(16, (max(all_end) + 1048575) // 1048576)::BIGINT AS block, max(all_end) AS all_end, min(stop) FILTER (WHERE stop > 0) AS least_end FROM p),
n AS (SELECT block, slots + least(slots, (4 * all_end + least_end - 1) // least_end) AS slots FROM (SELECT *, (all_end + block - 1) // block AS slots FROM b)),
x AS (SELECT t.t, (t.t * 2654435769) % 4294967296 AS x FROM (SELECT unnest(range(slots::BIGINT)) AS t FROM n) t),
met AS (SELECT place, row_number() OVER (PARTITION BY place ORDER BY t) - 1 AS rank FROM x JOIN p ON x >= lo AND x < hi),
had AS (SELECT place, count(*) AS had FROM met GROUP BY place),
k AS (SELECT place, rank FROM met
      UNION ALL SELECT place, unnest(range(coalesce(had, 0)::BIGINT, ((stop + block - 1) // block)::BIGINT)) AS rank FROM p LEFT JOIN had USING (place), n WHERE stop > 0),
l AS (SELECT d.*, place, source_size, target, stop, row_number() OVER () AS uid,
        sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
r AS (SELECT uid, place, start + epoch * source_size AS at_, least(start + epoch * source_size + size, stop) AS upto
      FROM l, (VALUES (0), (1)) v(epoch) WHERE size > 0 AND start + epoch * source_size < stop),
q AS (SELECT uid, place, at_, upto, block, unnest(range((at_ // block)::BIGINT, ((upto - 1) // block + 1)::BIGINT)) AS rank FROM r, n),
o AS (SELECT uid, sum(least(upto, (q.rank + 1) * block) - greatest(at_, q.rank * block))::BIGINT AS taken FROM q JOIN k ON q.place = k.place AND q.rank = k.rank GROUP BY uid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM l LEFT JOIN o USING (uid)
"""

ORACLES = {"op4_exact_dedup": OP4, "op6_mixing": OP6}
