"""Queries op11, op12 and op13 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandflow.llm._session import table
from strandflow.llm._store import drop
from strandflow.llm.centroids import clustered
from strandflow.llm.html_article import extract
from strandflow.llm.lexical_search import build_index, search


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's ten best documents."""
    index = build_index(table(spark, sf_dir, "documents"))
    out = search(index, table(spark, sf_dir, "benchmark"), 10)
    drop(index.shards)
    return out


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector with its cluster after ten rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def op13_html_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op11_lexical_search": op11_lexical_search, "op12_centroids": op12_centroids, "op13_html_article": op13_html_article}

_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 10 + (90 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
x AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10
"""

_NEAREST = """
a{r} AS MATERIALIZED (SELECT i, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT i, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda j: (v[j] - m[j]) * (v[j] - m[j])))::BIGINT AS d FROM k, c{r}) GROUP BY ALL)"""
_MEANS = """
c{s} AS MATERIALIZED (SELECT c, coalesce(new, m) AS m FROM c{r} LEFT JOIN (SELECT c, list(CAST(floor(x / n) AS BIGINT) ORDER BY j) AS new
  FROM (SELECT c, j, sum(v[j])::BIGINT AS x, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS j) GROUP BY c, j) GROUP BY c) USING (c))"""
_OP12 = (
    """
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS m FROM k QUALIFY c < 8),"""
    + ",".join(_NEAREST.format(r=r) + "," + _MEANS.format(r=r, s=r + 1) for r in range(10))
    + ","
    + _NEAREST.format(r=10)
    + """
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a10 JOIN c10 USING (c)
"""
)

# What the method must find where a page marks its article, as those of the tables do: the blocks of the article element.
_OP13 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS inner_html FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(replace(inner_html, '<br>', ' '), '</?b>', '', 'g'), '</?(p|h1)>', chr(1), 'g'), chr(1)) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

ORACLES = {"op11_lexical_search": _OP11, "op12_centroids": _OP12, "op13_html_article": _OP13}
