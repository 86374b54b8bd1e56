"""The queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_text, jaccard_join, language, lexical_search, mixing, packing, quality, substrings, token_counts, token_store, toxicity, vector_codes
from .common import table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_documents(token_store.write_shards(table(spark, sf_dir, "documents")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(packing.pieces(table(spark, sf_dir, "documents")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_store, op2_fingerprints, op3_substring_dedup, op4_best_fit_packing, op5_html_text, op6_quality_rules, op7_language,
            op8_source_mix, op9_jaccard_join, op10_token_counts, op11_vector_codes, op12_toxicity, op13_lexical_search,
        )
    }


#: Words of every text, for DuckDB.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - 34)) AS s FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, s, count(*) OVER (PARTITION BY array_to_string(w[s + 1 : s + 35], ' ')) AS c FROM p),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM g, range(35) AS t(o) WHERE c > 1),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, least(len(w), 1)))) AS s FROM d),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + 4], ' ') AS k FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g AS a JOIN g AS b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY ALL
"""


def _op11(parts: int = 4, rounds: int = 4, entries: int = 256) -> str:
    """Unrolled rounds: lists of doubles hold integers exactly."""
    s = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT i, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS x FROM v, range({parts}) AS t(p)),
n AS MATERIALIZED (SELECT *, list_dot_product(x, x) AS s FROM q),
b0 AS MATERIALIZED (SELECT p, i AS k, x, s FROM n WHERE i < {entries}),
"""
    for r in range(rounds + 1):
        s += f"a{r} AS MATERIALIZED (SELECT i, n.p, any_value(n.x) AS x, min(struct_pack(d := n.s + b.s - 2 * list_dot_product(n.x, b.x), k := b.k)) AS m FROM n JOIN b{r} AS b USING (p) GROUP BY i, n.p),\n"
        if r < rounds:
            s += f"""u{r} AS (SELECT p, k, list(y ORDER BY j) AS x FROM (SELECT p, m.k AS k, j, floor(sum(x[j]) / count(*)) AS y FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM n) + 1)) AS j) GROUP BY p, m.k, j) GROUP BY p, k),
b{r + 1} AS MATERIALIZED (SELECT p, k, x, list_dot_product(x, x) AS s FROM (SELECT b.p, b.k, coalesce(u.x, b.x) AS x FROM b{r} AS b LEFT JOIN u{r} AS u USING (p, k))),
"""
    s += f"""c AS (SELECT i, string_agg(lower(lpad(to_hex(m.k), 2, '0')), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY i),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, k)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN v USING (i), h
"""
    return s


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP13 = f"""
WITH t AS MATERIALIZED (SELECT doc_id, rid, unnest(w) AS term FROM (SELECT doc_id, row_number() OVER () AS rid, {_TERMS} AS w FROM documents)),
f AS MATERIALIZED (SELECT doc_id, rid, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT rid, sum(tf) AS n FROM f GROUP BY rid),
g AS (SELECT count(*) AS nn, sum(n) AS l FROM d),
m AS (SELECT rid, CAST(75 + (25 * CAST(n AS BIGINT) * nn) // CAST(l AS BIGINT) AS BIGINT) AS m FROM d, g),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, g GROUP BY term),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, rid, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item_id, doc_id, rid),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": _OP3, "op9_jaccard_join": _OP9, "op11_vector_codes": _op11(), "op13_lexical_search": _OP13}
