"""Queries op1, op2 and op8 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm._session import table
from strandflow.llm.mixing import mix
from strandflow.llm.sharding import shard_documents
from strandflow.llm.url_reputation import filter_urls

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards; sizes near equal (law `bytes`)."""
    out = shard_documents(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by the rules, else by its host's reputation, with its host's labels, mean and bound; a page is bad if its document is toxic or of low quality."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), labels, RULES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; sources weigh 1, 2, 3 in turn and targets stop at three times the source."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard")


QUERIES = {"op1_sharding": op1_sharding, "op2_url_reputation": op2_url_reputation, "op8_mixing": op8_mixing}

_OP1 = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
h AS (SELECT doc_id, list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda q: instr('123456789ABCDEF', q)) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (SELECT doc_id, n, list_transform(range(n), lambda k: (x[2 * k + 1] * 16 + x[2 * k + 2])::BIGINT) AS bytes FROM h),
d AS (SELECT b.doc_id, (n + 16)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, y: xor(a >> 8, crc[(xor(a, y) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
    (('0x' || substr(md5(coalesce(b.doc_id::VARCHAR, '')), 1, 8))::BIGINT % 4096)::INT AS virtual_slot FROM b, t),
s AS (SELECT virtual_slot, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS k FROM d GROUP BY virtual_slot),
f(k, loads, shard) AS (SELECT 0::BIGINT, list_transform(range(40), lambda i: 0::BIGINT), -1
    UNION ALL SELECT s.k, list_transform(f.loads, lambda v, i: CASE WHEN i = list_position(f.loads, list_min(f.loads)) THEN v + s.bytes ELSE v END), list_position(f.loads, list_min(f.loads)) - 1 FROM f JOIN s ON s.k = f.k + 1),
m AS (SELECT virtual_slot, shard FROM s JOIN f USING (k))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id, text_crc32) - 1 AS slot, NULL::INT AS grown_shard, virtual_slot FROM d JOIN m USING (virtual_slot)
"""

_OP2 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
lab AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, string_split(host, '.') AS l, count(lab.bad) AS n, coalesce(sum(lab.bad), 0)::BIGINT AS bad FROM p LEFT JOIN lab USING (page_id) GROUP BY host),
h1 AS (SELECT *, len(l) AS c, CASE WHEN len(l) >= 3 AND l[len(l) - 1] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND length(l[len(l)]) = 2 THEN 2 ELSE 1 END AS k FROM h0),
h AS (SELECT host, n, bad, CASE WHEN c < 2 THEN host ELSE array_to_string(l[greatest(c - k, 1):c], '.') END AS domain,
        CASE WHEN c < 2 THEN host ELSE array_to_string(l[greatest(c - k + 1, 1):c], '.') END AS suffix FROM h1),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM d GROUP BY suffix),
lv AS (SELECT 'h' AS lev, n, bad FROM h WHERE n > 0 UNION ALL SELECT 'd', n, bad FROM d WHERE n > 0 UNION ALL SELECT 's', n, bad FROM s WHERE n > 0),
t AS (SELECT lev, sum(n)::DOUBLE AS t, sum(bad)::DOUBLE AS b, sum(n::DOUBLE * n) AS nn, count(*)::DOUBLE AS k, sum(bad::DOUBLE * bad / n) AS bb FROM lv GROUP BY lev),
r AS (SELECT lev, least(greatest(coalesce((bb - b / t * b - b / t * (1 - b / t) * (k - 1)) / nullif(b / t * (1 - b / t) * (t - nn / t - (k - 1)), 0), 0), 0.0001), 0.5) AS rho FROM t),
m AS (SELECT coalesce(max(CASE WHEN lev = 's' THEN (1 - rho) / rho END), 9999.0) AS ms, coalesce(max(CASE WHEN lev = 'd' THEN (1 - rho) / rho END), 9999.0) AS md,
        coalesce(max(CASE WHEN lev = 'h' THEN (1 - rho) / rho END), 9999.0) AS mh FROM r),
p0 AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(n), 0), 0) AS p0 FROM s),
s2 AS (SELECT suffix, (bad + ms * p0) / (n + ms) AS ps FROM s, m, p0),
d2 AS (SELECT domain, suffix, (bad + md * ps) / (n + md) AS pd FROM d JOIN s2 USING (suffix), m),
h2 AS (SELECT host, n, bad, mh, (bad + mh * pd) / (n + mh) AS mean FROM h JOIN d2 USING (domain, suffix), m),
rep AS (SELECT host, n AS labelled, bad, mean, mean - 1.645 * sqrt(mean * (1 - mean) / (n + mh + 1)) AS bound, round(mean - 1.645 * sqrt(mean * (1 - mean) / (n + mh + 1)), 9) > 0.5 AS bad_host FROM h2),
ruled AS (SELECT page_id, host, path,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, ruled.host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad_host THEN 'block' ELSE 'allow' END AS verdict, labelled, bad, round(mean, 6) AS mean, round(bound, 6) AS bound
FROM ruled JOIN rep ON ruled.host = rep.host
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '~') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 1024)::INT AS bucket, md5(concat_ws('|', 'mix', doc_id::VARCHAR)) AS o FROM documents),
c0 AS (SELECT source, bucket, (bucket // 64)::INT AS shard, sum(size)::BIGINT AS n FROM d GROUP BY ALL),
c AS (SELECT source, bucket, shard, coalesce(sum(n) OVER (PARTITION BY source, shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(n) OVER (PARTITION BY source, shard)::BIGINT AS cell FROM c0),
t0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source) AS rank FROM d GROUP BY source),
t1 AS (SELECT *, ((rank - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM t0),
t2 AS (SELECT *, sum(w) OVER ()::BIGINT AS aw, sum(source_size) OVER ()::BIGINT AS az,
    coalesce(sum(w) OVER u, 0)::BIGINT AS w0, coalesce(sum(cap) OVER u, 0)::BIGINT AS c0 FROM t1 WINDOW u AS (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t3 AS (SELECT *, cap * (aw - w0) <= w * (az - c0) AS full_ FROM t2),
t4 AS (SELECT *, coalesce(sum(w) FILTER (full_) OVER (), 0)::BIGINT AS fw, coalesce(sum(cap) FILTER (full_) OVER (), 0)::BIGINT AS fc FROM t3),
t5 AS (SELECT source, rank, source_size, az, CASE WHEN full_ THEN cap::DOUBLE ELSE (w * (az - fc))::DOUBLE / (aw - fw) END AS target FROM t4),
a1 AS (SELECT *, az // 32 AS seats, sum(target) OVER () AS v, count(*) OVER ()::DOUBLE AS k FROM t5),
a2 AS (SELECT *, CASE WHEN v > 0 AND seats > k / 2 THEN floor(target * (seats - k / 2) / v + 0.5) ELSE 0 END::BIGINT AS sure FROM a1),
a3 AS (SELECT *, (seats - sum(sure) OVER ())::BIGINT AS rem FROM a2),
a4 AS (SELECT rank, rem, target / (2 * unnest(range(sure, sure + CASE WHEN v > 0 THEN least(floor(target * greatest(k, rem) / v)::BIGINT + 2, rem) ELSE 0 END)) + 1) AS q FROM a3),
a5 AS (SELECT rank FROM a4 WHERE q > 0 QUALIFY row_number() OVER (ORDER BY q DESC, rank) <= rem),
b AS (SELECT source, rank, source_size, target, sure + coalesce((SELECT count(*) FROM a5 WHERE a5.rank = a3.rank), 0) AS blocks FROM a3),
e0 AS (SELECT DISTINCT c.source, rank, source_size, target, blocks, shard, cell FROM c JOIN b USING (source)),
e1 AS (SELECT *, sum(cell) OVER (PARTITION BY rank)::DOUBLE AS v, count(*) OVER (PARTITION BY rank)::DOUBLE AS k FROM e0),
e2 AS (SELECT *, CASE WHEN v > 0 AND blocks > k / 2 THEN floor(cell::DOUBLE * (blocks - k / 2) / v + 0.5) ELSE 0 END::BIGINT AS sure FROM e1),
e3 AS (SELECT *, (blocks - sum(sure) OVER (PARTITION BY rank))::BIGINT AS rem FROM e2),
e4 AS (SELECT rank, shard, rem, cell::DOUBLE / (2 * unnest(range(sure, sure + CASE WHEN v > 0 THEN least(floor(cell::DOUBLE * greatest(k, rem) / v)::BIGINT + 2, rem) ELSE 0 END)) + 1) AS q FROM e3),
e5 AS (SELECT rank, shard FROM e4 WHERE q > 0 QUALIFY row_number() OVER (PARTITION BY rank ORDER BY q DESC, shard) <= rem),
e6 AS (SELECT rank, shard, count(*) AS won FROM e5 GROUP BY ALL),
f0 AS (SELECT e3.*, least((sure + coalesce(won, 0)) * 32, 3 * cell)::BIGINT AS take FROM e3 LEFT JOIN e6 USING (rank, shard)),
f AS (SELECT source, shard, source_size, target, cell, CASE WHEN cell > 0 THEN take // cell ELSE 0 END AS passes, take - CASE WHEN cell > 0 THEN take // cell ELSE 0 END * cell AS rest,
    ('0x' || substr(md5('mix|' || rank || '|' || shard), 1, 8))::BIGINT % greatest(ceil(cell / 32.0)::BIGINT, 1) * 32 AS frm FROM f0),
g AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source, bucket ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
x AS (SELECT doc_id, size, f.source_size, f.target, f.shard, passes, rest, frm, f.cell, (start + before)::BIGINT AS a FROM g JOIN c ON g.source = c.source AND g.bucket = c.bucket JOIN f ON f.source = c.source AND f.shard = c.shard)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(a + size, frm + rest) - greatest(a, frm)) + greatest(0, least(a + size, frm + rest - cell) - a))::BIGINT AS taken, shard FROM x
"""

ORACLES = {"op1_sharding": _OP1, "op2_url_reputation": _OP2, "op8_mixing": _OP8}
