"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op4_poisson_mix": """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM sizes),
wanted AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS j FROM rates),
steps AS (SELECT source, rate, j, sum(exp(-rate + j * ln(rate) - lgamma(j + 1))) OVER (
              PARTITION BY source ORDER BY j ROWS UNBOUNDED PRECEDING) AS cdf FROM wanted),
cdfs AS (SELECT source, rate, list(cdf ORDER BY j) AS cdf FROM steps GROUP BY source, rate),
drawn AS (SELECT d.*, r.rate, r.cdf,
              ('0x' || substr(md5('0:draw:' || doc_id), 1, 13))::BIGINT / pow(16, 13) AS u
          FROM documents d JOIN cdfs r ON d.source IS NOT DISTINCT FROM r.source),
counted AS (SELECT *, len(list_filter(cdf, lambda c: c <= u))::INTEGER AS copies FROM drawn),
repeated AS (SELECT *, unnest(generate_series(1, copies::BIGINT)) AS k FROM counted)
SELECT doc_id, text, lang, source, n_chars, k::INTEGER AS copy, copies, rate,
       md5('0:place:' || doc_id || ':' || k) AS place
FROM repeated""",
    "op8_block_join": """
WITH usable AS (
    SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x != 0)) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    GROUP BY vec_id),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
    FROM usable q JOIN usable c ON q.vec_id != c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op11_threshold_join": """
WITH usable AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.id != b.id AND len(a.v) = len(b.v) WHERE a.id % 50 = 0),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
    SELECT p.*, s.id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
    FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
     AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3""",
}
