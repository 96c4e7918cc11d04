"""Scoring, duplicates and ensemble over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import duplicates as D
from quillgraph.operators import ensemble as M
from quillgraph.operators import scoring as P
from quillgraph.operators import training as T
from quillgraph.plans.registry import query
from quillgraph.session import cut_lineage, table
from quillgraph.sources.catalogue import with_catalogue

DIM = 64


def class_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The class model as a written table: it is fitted once, and the planner knows its size."""
    return cut_lineage(P.class_centroids(table(spark, sf, "embeddings"), "embedding", "label", DIM))


def scored_vectors(spark: SparkSession, sf: str, kind: str = "scaled_dot", scale: float = 20.0, centers: DataFrame | None = None) -> DataFrame:
    """Embeddings with ranking, entropy and what else the merged states of their class blocks give."""
    centers = class_vectors(spark, sf) if centers is None else centers
    items = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return P.state_entropy(P.score_states(items, centers, "vec_id", "embedding", kind, scale, "label"))


def class_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("r_name").alias("category"))


def logit_sql(kind: str, scale: float) -> str:
    return {
        "scaled_dot": f"{scale} * sum(x.v * c.c) / any_value(n.nrm)",
        "dot": f"{scale} * sum(x.v * c.c)",
        "cosine": f"{scale} * sum(x.v * c.c) / (any_value(n.nrm) * sqrt(sum(x.v * x.v)))",
        "neg_l2": f"-{scale} * sqrt(sum((x.v - c.c) * (x.v - c.c)))",
    }[kind]


def vectors_sql(tag: str = "", kind: str = "scaled_dot", scale: float = 20.0) -> str:
    """CTEs x, c, n (shared) and l, p, r (per scorer) for the oracles."""
    shared = """
x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT label AS class_id, d, avg(v) AS c FROM x GROUP BY 1, 2),
n AS (SELECT class_id, sqrt(sum(c * c)) AS nrm FROM c GROUP BY 1),"""
    own = f"""
l{tag} AS (SELECT x.vec_id, any_value(x.label) AS label, c.class_id, {logit_sql(kind, scale)} AS logit
  FROM x JOIN c USING (d) JOIN n USING (class_id) GROUP BY x.vec_id, c.class_id),
m{tag} AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM l{tag}),
p{tag} AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM m{tag}),
r{tag} AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, class_id) AS rank,
  round(prob * 100, 2) AS confidence FROM p{tag})"""
    return (shared if tag == "" else "") + own


ENT_SQL = """,
h AS (SELECT vec_id, sum(CASE WHEN prob > 1e-12 THEN -prob * ln(prob) ELSE 0 END) AS h, count(*) AS k FROM p GROUP BY 1),
o AS (SELECT vec_id, round(h, 4) AS entropy, round(h / ln(k), 4) AS normalized_entropy, h / ln(k) > 0.55 AS is_ood FROM h),
t AS (SELECT r.vec_id, r.label, r.class_id, r.confidence, r.prob, o.entropy, o.normalized_entropy, o.is_ood
  FROM r JOIN o USING (vec_id) WHERE r.rank = 1)"""
CAT_SQL = """,
cat AS (SELECT n_nationkey AS id, n_name AS label, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey)"""
V4 = "WITH " + vectors_sql()


@query("p1_linear_scores", V4 + " SELECT vec_id, class_id, round(logit, 6) AS logit FROM l")
def p1(spark, sf):
    rows = P.linear_scores(table(spark, sf, "embeddings"), class_vectors(spark, sf), "vec_id", "embedding")
    return rows.withColumn("logit", F.round("logit", 6))


@query("p1_linear_scores_blocks", V4 + " SELECT vec_id, class_id, round(logit, 6) AS logit FROM l")
def p1_blocks(spark, sf):
    rows = P.linear_scores(table(spark, sf, "embeddings"), class_vectors(spark, sf), "vec_id", "embedding", per_block=4)
    return rows.withColumn("logit", F.round("logit", 6))


@query("p2_softmax", V4 + " SELECT vec_id, class_id, round(prob, 6) AS prob FROM p")
def p2(spark, sf):
    items, centers = table(spark, sf, "embeddings"), class_vectors(spark, sf)
    states = P.score_states(items, centers, "vec_id", "embedding")
    rows = P.probabilities(P.linear_scores(items, centers, "vec_id", "embedding"), states, "vec_id")
    return rows.select("vec_id", "class_id", F.round("prob", 6).alias("prob"))


@query("p5_states_of_small_blocks", V4 + ENT_SQL + " SELECT vec_id, class_id, confidence, entropy, normalized_entropy, is_ood FROM t")
def p5_blocks(spark, sf):
    states = P.score_states(table(spark, sf, "embeddings"), class_vectors(spark, sf), "vec_id", "embedding", per_block=3)
    return P.top_1(P.state_entropy(states)).select("vec_id", "class_id", "confidence", "entropy", "normalized_entropy", "is_ood")


@query("p3_top_k", V4 + CAT_SQL + """
SELECT r.vec_id, r.rank::INTEGER AS rank, r.class_id, r.confidence, coalesce(cat.label, r.class_id::VARCHAR) AS label,
  coalesce(cat.category, 'unknown') AS category
FROM r LEFT JOIN cat ON cat.id = r.class_id WHERE r.rank <= 5""")
def p3(spark, sf):
    top = P.top_k(scored_vectors(spark, sf), "vec_id", 5)
    return with_catalogue(top, class_catalogue(spark, sf)).select(
        "vec_id", "rank", "class_id", "confidence", "label", "category")


@query("p4_top_1", V4 + " SELECT vec_id, class_id, confidence FROM r WHERE rank = 1")
def p4(spark, sf):
    return P.top_1(scored_vectors(spark, sf)).select("vec_id", "class_id", "confidence")


@query("p5_entropy_ood", V4 + ENT_SQL + " SELECT vec_id, entropy, normalized_entropy, is_ood FROM o")
def p5(spark, sf):
    return scored_vectors(spark, sf).select("vec_id", "entropy", "normalized_entropy", "is_ood")


@query("p6_confidence_band", V4 + """
SELECT (CASE WHEN confidence >= 70 THEN 1 WHEN confidence >= 40 THEN 2 WHEN confidence >= 20 THEN 3 ELSE 4 END)::INTEGER AS band,
  (CASE WHEN confidence >= 70 THEN 1 WHEN confidence >= 40 THEN 2 ELSE 3 END)::INTEGER AS repo_band, count(*) AS n
FROM r WHERE rank = 1 GROUP BY 1, 2""")
def p6(spark, sf):
    top = P.top_1(scored_vectors(spark, sf))
    return top.groupBy(
        P.confidence_band(F.col("confidence")).alias("band"),
        P.confidence_band(F.col("confidence"), (70, 40)).alias("repo_band"),
    ).agg(F.count(F.lit(1)).alias("n"))


ADMITTED_SQL = """,
s AS (SELECT d.doc_id, CASE WHEN d.n_chars > 3000 THEN 'too_long' WHEN o.vec_id IS NULL THEN 'not_scored' END AS error, o.is_ood
  FROM documents d LEFT JOIN o ON o.vec_id = d.doc_id)"""


@query("p7_score_counters", V4 + ENT_SQL + ADMITTED_SQL + """
SELECT count(*) AS n_files, count(error) AS n_errors, count(*) - count(error) AS n_analysed,
  count(*) FILTER (WHERE error IS NULL AND is_ood) AS n_ood FROM s""")
def p7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    scored = scored_vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "is_ood", F.lit(True).alias("scored"))
    error = F.when(F.col("n_chars") > 3000, "too_long").when(F.col("scored").isNull(), "not_scored")
    return P.score_counters(docs.join(scored, "doc_id", "left").withColumn("error", error))


@query("p8_category_histogram", V4 + CAT_SQL + """,
g AS (SELECT coalesce(cat.category, 'unknown') AS category, count(*) AS n FROM r LEFT JOIN cat ON cat.id = r.class_id
  WHERE rank = 1 GROUP BY 1)
SELECT category, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS pct, floor(n * 20.0::DOUBLE / max(n) OVER () + 0.5)::BIGINT AS bar FROM g""")
def p8(spark, sf):
    return P.category_histogram(with_catalogue(P.top_1(scored_vectors(spark, sf)), class_catalogue(spark, sf)))


@query("p9_top_labels_with_samples", V4 + """,
a AS (SELECT class_id, vec_id, row_number() OVER (PARTITION BY class_id ORDER BY vec_id) AS i FROM r WHERE rank = 1)
SELECT class_id, count(*) AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) FILTER (WHERE i <= 2) AS samples,
  greatest(count(*) - 2, 0)::BIGINT AS n_more FROM a GROUP BY 1 ORDER BY n DESC, class_id LIMIT 10""")
def p9(spark, sf):
    out = P.top_labels_with_samples(P.top_1(scored_vectors(spark, sf)), "class_id", "vec_id")
    return out.withColumn("samples", F.concat_ws(",", F.col("samples").cast("array<string>")))


@query("t4_cross_entropy", V4 + """,
z AS (SELECT vec_id, max(logit) AS peak, ln(sum(e)) AS lse, max(CASE WHEN class_id = label THEN logit END) AS y FROM m GROUP BY 1)
SELECT round(avg(peak + lse - y), 6) AS cross_entropy, count(*) AS n FROM z""")
def t4(spark, sf):
    return T.cross_entropy(scored_vectors(spark, sf))


@query("t5_accuracy", V4 + """
SELECT round(avg(CASE WHEN class_id = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n FROM r WHERE rank = 1""")
def t5(spark, sf):
    return T.accuracy(P.top_1(scored_vectors(spark, sf)), "label", "class_id")


@query("t5_confusion", V4 + """
SELECT label, class_id AS predicted, count(*) AS n FROM r WHERE rank = 1 GROUP BY 1, 2""")
def t5_confusion(spark, sf):
    return T.confusion(P.top_1(scored_vectors(spark, sf)), "label", "class_id")


GROUPS = ",\ng AS (SELECT vec_id, class_id, confidence FROM t WHERE NOT is_ood AND confidence >= 70)"


def named_scores(spark, sf):
    """All embeddings as inputs with their best class, as the duplicate finder takes them."""
    scored = P.top_1(scored_vectors(spark, sf))
    return scored.select("vec_id", "class_id", "confidence", "entropy", "normalized_entropy", "is_ood")


@query("d1_duplicate_groups", V4 + ENT_SQL + GROUPS + """,
k AS (SELECT class_id, count(*) AS group_size FROM g GROUP BY 1 HAVING count(*) >= 2)
SELECT class_id, vec_id, confidence, group_size FROM g JOIN k USING (class_id)""")
def d1(spark, sf):
    return D.duplicate_groups(named_scores(spark, sf), "vec_id")


@query("d1_inputs_with_failures", V4 + ENT_SQL + """
SELECT d.doc_id, 'function_' || (d.doc_id + 1) AS name, t.class_id, coalesce(t.confidence, 0) AS confidence
FROM documents d LEFT JOIN t ON t.vec_id = d.doc_id AND d.n_chars <= 3000""")
def d1_inputs(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.lit(None).cast("string").alias("name"), (F.col("doc_id") + 1).alias("seq"))
    admitted = docs.filter("n_chars <= 3000").select("doc_id").join(
        named_scores(spark, sf).withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return D.attach_scores(D.name_inputs(docs), admitted, "doc_id").select("doc_id", "name", "class_id", "confidence")


@query("d2_ood_side_output", V4 + ENT_SQL + """
SELECT vec_id, entropy, normalized_entropy, class_id, confidence FROM t WHERE is_ood""")
def d2(spark, sf):
    return D.ood_side_output(named_scores(spark, sf), "vec_id")


@query("d3_pairwise_compare", V4 + ENT_SQL + """
SELECT a.vec_id AS left_id, b.vec_id AS right_id, a.is_ood OR b.is_ood AS cannot_compare,
  NOT (a.is_ood OR b.is_ood) AND a.class_id = b.class_id AND a.confidence >= 70 AND b.confidence >= 70 AS is_duplicate,
  CASE WHEN NOT (a.is_ood OR b.is_ood) AND a.class_id = b.class_id AND a.confidence >= 70 AND b.confidence >= 70 THEN a.class_id END AS class_id,
  a.class_id AS left_class_id, b.class_id AS right_class_id, a.confidence AS left_confidence, b.confidence AS right_confidence,
  concat_ws('; ', CASE WHEN a.is_ood THEN 'left out of distribution, entropy ' || floor(a.normalized_entropy * 100 + 0.5)::BIGINT || '%' END,
    CASE WHEN b.is_ood THEN 'right out of distribution, entropy ' || floor(b.normalized_entropy * 100 + 0.5)::BIGINT || '%' END) AS reason
FROM t a JOIN t b ON b.vec_id = a.vec_id + 1""")
def d3(spark, sf):
    scored = named_scores(spark, sf)
    pairs = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    return D.pairwise_compare(pairs, scored, "vec_id")


ENGINES = (("dot", 60.0), ("cosine", 12.0), ("neg_l2", 8.0))


def engine_predictions(spark, sf):
    """Three scorers as engines; the second one gives up on items it finds out of distribution."""
    results = []
    centers = class_vectors(spark, sf)
    for order, (kind, scale) in enumerate(ENGINES):
        scored = scored_vectors(spark, sf, kind, scale, centers)
        top = scored.select(
            F.col("vec_id").alias("item"), "is_ood",
            F.posexplode(F.slice("ranking", 1, 5)).alias("_pos", "_best"),
        ).select(
            "item", "is_ood", F.lit(kind).alias("engine"), F.lit(order).alias("engine_order"),
            (F.col("_pos") + 1).alias("rank"), F.col("_best.class_id").alias("class_id"),
            P.percent(-F.col("_best.neg")).alias("confidence"))
        gives_up = F.col("is_ood") if order == 1 else F.lit(False)
        results.append(M.fail_where(top, gives_up, "out of distribution"))
    return M.combine_engines(results)


def _engines_sql() -> str:
    parts, union = [], []
    for order, (kind, scale) in enumerate(ENGINES):
        tag = "" if order == 0 else str(order)
        parts.append(vectors_sql(tag, kind, scale))
        fails = f"vec_id IN (SELECT vec_id FROM h{tag} WHERE h / ln(k) > 0.55)" if order == 1 else "false"
        if order == 1:
            parts.append(f"\nh{tag} AS (SELECT vec_id, sum(CASE WHEN prob > 1e-12 THEN -prob * ln(prob) ELSE 0 END) AS h, count(*) AS k FROM p{tag} GROUP BY 1)")
        union.append(f"SELECT vec_id AS item, '{kind}' AS engine, {order} AS engine_order, rank, class_id, confidence, "
                     f"NULL AS error FROM r{tag} WHERE rank <= 5 AND NOT ({fails})")
        if order == 1:
            union.append(f"SELECT vec_id, '{kind}', {order}, NULL, NULL, NULL, 'out of distribution' FROM r{tag} WHERE rank = 1 AND {fails}")
    return "WITH " + ",".join(parts) + ",\nv AS (" + "\nUNION ALL ".join(union) + ")"


V5 = _engines_sql()
VOTES = """,
w AS (SELECT item, class_id, count(*) AS votes, (floor(sum(round(confidence * 100)::BIGINT)::DOUBLE / count(*) + 0.5) / 100.0)::DOUBLE AS avg_confidence FROM v WHERE class_id IS NOT NULL GROUP BY 1, 2)"""


@query("m1_engine_union", V5 + VOTES + """,
z AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY avg_confidence DESC, votes DESC, class_id) AS rank FROM w)
SELECT item, class_id, votes, avg_confidence, rank::INTEGER AS rank FROM z WHERE rank <= 5""")
def m1(spark, sf):
    return M.engine_union(engine_predictions(spark, sf))


@query("m2_engine_intersection", V5 + VOTES + """,
q AS (SELECT item, count(DISTINCT engine) AS k FROM v WHERE class_id IS NOT NULL GROUP BY 1)
SELECT item, class_id, votes, avg_confidence FROM w JOIN q USING (item) WHERE votes >= k""")
def m2(spark, sf):
    return M.engine_intersection(engine_predictions(spark, sf))


@query("m3_engine_first", V5 + """,
f AS (SELECT item, min(engine_order) AS engine_order FROM v WHERE class_id IS NOT NULL GROUP BY 1)
SELECT item, engine, rank::INTEGER AS rank, class_id, confidence FROM v JOIN f USING (item, engine_order) WHERE class_id IS NOT NULL""")
def m3(spark, sf):
    return M.engine_first(engine_predictions(spark, sf))


@query("m3_engine_first_reordered", V5 + """,
u AS (SELECT * REPLACE (CASE engine WHEN 'cosine' THEN 0 WHEN 'dot' THEN 1 ELSE 2 END AS engine_order) FROM v),
f AS (SELECT item, min(engine_order) AS engine_order FROM u WHERE class_id IS NOT NULL GROUP BY 1)
SELECT item, engine, rank::INTEGER AS rank, class_id, confidence FROM u JOIN f USING (item, engine_order) WHERE class_id IS NOT NULL""")
def m3_reordered(spark, sf):
    # The engine that can fail leads the list, so its failures hand over to the next one.
    order = F.when(F.col("engine") == "cosine", 0).when(F.col("engine") == "dot", 1).otherwise(2)
    return M.engine_first(engine_predictions(spark, sf).withColumn("engine_order", order))


@query("m4_engine_failure_isolation", V5 + """
SELECT engine, engine_order::INTEGER AS engine_order, count(DISTINCT item) FILTER (WHERE error IS NULL) AS n_answered,
  count(DISTINCT item) FILTER (WHERE error IS NOT NULL) AS n_failed, max(error) AS error FROM v GROUP BY 1, 2""")
def m4(spark, sf):
    return M.engine_status(engine_predictions(spark, sf))
