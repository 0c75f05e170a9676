"""Queries of vector retrieval, consensus, pair mining and pose lookup."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators import retrieval
from skylattice.plans.base import r
from skylattice.registry import query
from skylattice.sources import domain
from skylattice.sources.domain import with_tables

c = lambda name: F.col(name)
K = 5

TOP = f""", pairs AS (SELECT q.id AS query, d.id, list_dot_product(q.embedding, d.embedding) AS sim FROM landmarks q JOIN landmarks d ON q.id <> d.id WHERE q.id % 25 = 0),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM pairs) WHERE rank <= {K})
"""
FIX = TOP + """, near AS (SELECT t.*, max(sim) OVER (PARTITION BY query) AS best FROM top t),
w AS (SELECT n.query, n.id, n.sim, exp((n.sim - n.best) / CAST(0.02 AS DOUBLE)) AS w, l.e, l.n, l.u, l.heading FROM near n JOIN landmarks l ON l.id = n.id WHERE n.sim > n.best - CAST(0.08 AS DOUBLE)),
m AS (SELECT query, max(sim) AS similarity, count(*) AS k, sum(w * e) / sum(w) AS e, sum(w * n) / sum(w) AS n, sum(w * u) / sum(w) AS u,
  (degrees(atan2(sum(w * sin(radians(heading))), sum(w * cos(radians(heading))))) + 360) % 360 AS heading FROM w GROUP BY query),
fix AS (SELECT m.query, any_value(m.similarity) AS similarity, any_value(m.k) AS k, any_value(m.e) AS e, any_value(m.n) AS n, any_value(m.u) AS u, any_value(m.heading) AS heading,
  sum(w.w * (w.e - m.e) ** 2) / sum(w.w) AS ee, sum(w.w * (w.n - m.n) ** 2) / sum(w.w) AS nn, sum(w.w * (w.u - m.u) ** 2) / sum(w.w) AS uu, sum(w.w * (w.e - m.e) * (w.n - m.n)) / sum(w.w) AS en FROM w JOIN m USING (query) GROUP BY m.query)
"""


def top(spark, sf_dir):
    marks = domain.landmarks(spark, sf_dir)
    return retrieval.top_k(marks.where("id % 25 = 0"), marks, K)


def fixes(spark, sf_dir):
    return retrieval.consensus(top(spark, sf_dir), domain.landmarks(spark, sf_dir))


for name in ("J02_similar_landmarks", "T01_top_k"):

    @query(name, with_tables("landmarks", TOP + "SELECT query, id, rank, round(sim, 5) AS sim FROM top"))
    def similar_landmarks(spark, sf_dir):
        return top(spark, sf_dir).select("query", "id", "rank", r(c("sim"), 5).alias("sim"))


@query("P09_similarity_cut", with_tables("landmarks", FIX + "SELECT query, id FROM w"))
def similarity_cut(spark, sf_dir):
    best = F.max("sim").over(Window.partitionBy("query"))
    return top(spark, sf_dir).withColumn("best", best).where(c("sim") > c("best") - 0.08).select("query", "id")


@query("A17_consensus_fix", with_tables("landmarks", FIX + "SELECT query, k, round(similarity, 4) AS similarity, round(e, 3) AS e, round(n, 3) AS n, round(u, 3) AS u, round(sqrt(greatest(ee + nn + uu, 0)), 2) AS spread, round(ee + 0.5, 2) AS c_ee, round(en, 2) AS c_en FROM fix"))
def consensus_fix(spark, sf_dir):
    f = fixes(spark, sf_dir)
    return f.select("query", "k", r(c("similarity")).alias("similarity"), *[r(c(x), 3).alias(x) for x in "enu"], *[r(c(x), 2).alias(x) for x in ("spread", "c_ee", "c_en")])


@query("A18_circular_heading", with_tables("landmarks", FIX + "SELECT query, round(heading, 3) AS heading FROM fix"))
def circular_heading(spark, sf_dir):
    return fixes(spark, sf_dir).select("query", r(c("heading"), 3).alias("heading"))


RECALL = FIX + """, hits AS (SELECT t.query, bool_or(sqrt((l.e - q.e) ** 2 + (l.n - q.n) ** 2) < 300) AS hit FROM top t JOIN landmarks l ON l.id = t.id JOIN landmarks q ON q.id = t.query GROUP BY t.query)
"""


def hits(spark, sf_dir):
    marks = domain.landmarks(spark, sf_dir)
    truth = marks.select(c("id").alias("query"), c("e").alias("qe"), c("n").alias("qn"))
    near = top(spark, sf_dir).join(marks.select("id", "e", "n"), "id").join(truth, "query")
    return near.groupBy("query").agg(F.bool_or(geo.distance(c("e"), c("n"), c("qe"), c("qn")) < 300).alias("hit"))


@query("J24_recall_hits", with_tables("landmarks", RECALL + "SELECT query, hit FROM hits"))
def recall_hits(spark, sf_dir):
    return hits(spark, sf_dir)


@query(
    "A05_retrieval_metrics",
    with_tables("landmarks", RECALL + """SELECT round(avg(hit::INT::DOUBLE), 4) AS recall_at_k, round(quantile_cont(d, 0.5), 2) AS p50, round(quantile_cont(d, 0.95), 2) AS p95
FROM hits JOIN (SELECT f.query, sqrt((f.e - l.e) ** 2 + (f.n - l.n) ** 2) AS d FROM fix f JOIN landmarks l ON l.id = f.query) USING (query)"""),
)
def retrieval_metrics(spark, sf_dir):
    marks = domain.landmarks(spark, sf_dir).select(c("id").alias("query"), c("e").alias("qe"), c("n").alias("qn"))
    err = fixes(spark, sf_dir).join(marks, "query").select("query", geo.distance(c("e"), c("n"), c("qe"), c("qn")).alias("d"))
    both = hits(spark, sf_dir).join(err, "query")
    return both.agg(r(F.avg(c("hit").cast("double"))).alias("recall_at_k"), r(F.percentile("d", 0.5), 2).alias("p50"), r(F.percentile("d", 0.95), 2).alias("p95"))


PAIRS = """, pos AS (SELECT a.id AS i, b.id AS j, sqrt((a.e - b.e) ** 2 + (a.n - b.n) ** 2) AS apart FROM landmarks a JOIN landmarks b ON a.id < b.id
  WHERE sqrt((a.e - b.e) ** 2 + (a.n - b.n) ** 2) < 150 AND abs((a.heading - b.heading + 540) % 360 - 180) < 60)
"""


@query("J10_positive_pairs", with_tables("landmarks", PAIRS + "SELECT i, j, round(apart, 4) AS apart FROM pos"))
def positive_pairs(spark, sf_dir):
    return retrieval.positive_pairs(domain.landmarks(spark, sf_dir), 150.0, 60.0).select("i", "j", r(c("apart")).alias("apart"))


@query(
    "A56_hard_triplets",
    with_tables("landmarks", PAIRS + """, near AS (SELECT i, j FROM pos UNION ALL SELECT j, i FROM pos),
d AS (SELECT a.id AS anchor, b.id AS other, sqrt(greatest(2 - 2 * list_dot_product(a.embedding, b.embedding), 0)) AS d, n.i IS NOT NULL AS same FROM landmarks a JOIN landmarks b ON a.id <> b.id
  LEFT JOIN near n ON n.i = a.id AND n.j = b.id WHERE a.id % 25 = 0),
t AS (SELECT anchor, max(d) FILTER (same) AS far, min(d) FILTER (NOT same) AS close FROM d GROUP BY anchor)
SELECT anchor, round(far, 4) AS hardest_positive, round(close, 4) AS hardest_negative, round(greatest(0, far - close + CAST(0.3 AS DOUBLE)), 4) AS loss FROM t WHERE far IS NOT NULL AND close IS NOT NULL"""),
)
def hard_triplets(spark, sf_dir):
    """Hardest positive and negative of each anchor of a stated batch (ids divisible by 25) among all poses, in blocks."""
    marks = domain.landmarks(spark, sf_dir)
    found = retrieval.hardest(marks.where("id % 25 = 0").drop("u"), marks.drop("u"), 150.0, 60.0).where("far is not null and close is not null")
    loss = F.greatest(F.lit(0.0), c("far") - c("close") + 0.3)
    return found.select(c("query").alias("anchor"), r(c("far")).alias("hardest_positive"), r(c("close")).alias("hardest_negative"), r(loss).alias("loss"))


PRIOR = """, q AS (SELECT id AS query, e + 150 AS qe, n - 100 AS qn, embedding AS qv FROM landmarks WHERE id % 25 = 0),
s AS (SELECT query, d.id, list_dot_product(qv, d.embedding) AS sim, sqrt((d.e - qe) ** 2 + (d.n - qn) ** 2) < 120 AS inside FROM q JOIN landmarks d ON d.id <> q.query),
f AS (SELECT *, bool_or(inside) OVER (PARTITION BY query) AS any_in FROM s)
"""


@query("J22_prior_top_k", with_tables("landmarks", PRIOR + "SELECT query, id, rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM f WHERE inside OR NOT any_in) WHERE rank <= 3"))
def prior_top_k(spark, sf_dir):
    """Best three within a prior circle, by a cell join; queries whose circle is empty fall back to all landmarks."""
    marks = domain.landmarks(spark, sf_dir)
    asked = marks.where("id % 25 = 0").select("id", (c("e") + 150).alias("e"), (c("n") - 100).alias("n"), "embedding")
    near = retrieval.neighbours(asked, marks, 120.0).where("lid <> rid").select(c("lid").alias("query"), c("rid").alias("id"))
    vec = lambda key, name: marks.select(c("id").alias(key), c("embedding").alias(name))
    sims = near.join(vec("query", "qv"), "query").join(vec("id", "dv"), "id").select("query", "id", retrieval.dot(c("qv"), c("dv")).alias("sim"))
    rest = asked.join(near.select(c("query").alias("id")).distinct(), "id", "left_anti")
    everywhere = retrieval.top_k(rest.select("id", "embedding"), marks, 3).select("query", "id", "sim")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    return sims.unionByName(everywhere).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("query", "id", "rank")


@query(
    "J23_nearest_pose",
    with_tables("landmarks", """, s AS (SELECT q.id AS query, d.id, (d.e - q.e) ** 2 + (d.n - q.n) ** 2 + (3 * abs((d.heading - q.heading + 540) % 360 - 180)) ** 2 AS cost FROM landmarks q JOIN landmarks d ON q.id <> d.id WHERE q.id % 25 = 0)
SELECT query, arg_min(id, (cost, id)) AS id, round(min(cost), 3) AS cost FROM s GROUP BY query"""),
)
def nearest_pose(spark, sf_dir):
    """Cheapest index pose of a stated query set by distance and turn, block by block."""
    marks = domain.landmarks(spark, sf_dir)
    best = retrieval.nearest_poses(marks.where("id % 25 = 0"), marks)
    return best.select("query", "id", r(c("cost"), 3).alias("cost"))


@query(
    "T04_best_hypothesis",
    with_tables("landmarks", TOP + """, h AS (SELECT query, id, rank, CASE WHEN id % 7 = 0 THEN 0 ELSE sim END AS conf FROM top)
SELECT query, arg_max(id, (conf, -rank)) AS id, round(max(conf), 5) AS conf FROM h GROUP BY query"""),
)
def best_hypothesis(spark, sf_dir):
    """Most confident of the hypotheses; a veto sets its confidence to zero."""
    h = top(spark, sf_dir).withColumn("conf", F.when(c("id") % 7 == 0, 0.0).otherwise(c("sim")))
    return h.groupBy("query").agg(F.max_by("id", F.struct("conf", -c("rank"))).alias("id"), r(F.max("conf"), 5).alias("conf"))


@query("S16_landmark_tables", with_tables("landmarks", "SELECT CAST(floor(e / 500) AS BIGINT) AS ce, count(*) AS n, round(avg(list_dot_product(embedding, embedding)), 4) AS norm FROM landmarks GROUP BY 1"))
def landmark_tables(spark, sf_dir):
    marks = domain.landmarks(spark, sf_dir)
    return marks.groupBy(F.floor(c("e") / 500).alias("ce")).agg(F.count("*").alias("n"), r(F.avg(retrieval.dot(c("embedding"), c("embedding")))).alias("norm"))
