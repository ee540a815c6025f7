"""Queries over models and searches: gradients by chunk, predictions with a vote, the best of 100,000 splits."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, learning, relational, search
from . import inputs, spatial_queries
from .registry import query, table

CLASSES, WIDTH = 10, 64
_WEIGHT = "((c * 31 + j * 17) % 13 - 6) / 10.0::DOUBLE"
_BIAS = "(c % 3 - 1) / 5.0::DOUBLE"


def model() -> bytes:
    c, j = np.mgrid[0:CLASSES, 0:WIDTH]
    return learning.packed(((c * 31 + j * 17) % 13 - 6) / 10, (np.arange(CLASSES) % 3 - 1) / 5)


# the bias is the last component, of a vector's own 1
@query("q80_chunk_gradients", f"""WITH e AS (SELECT label, list_append(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 1.0::DOUBLE) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings),
  w AS (SELECT c, list(CASE WHEN j < {WIDTH} THEN {_WEIGHT} ELSE {_BIAS} END ORDER BY j) AS w FROM (SELECT unnest(range({CLASSES})) AS c) a, (SELECT unnest(range({WIDTH + 1})) AS j) b GROUP BY c),
  s AS (SELECT n, label, v, c, exp(list_dot_product(v, w)) AS s FROM e, w), p AS (SELECT *, s / sum(s) OVER (PARTITION BY n) - CASE WHEN c = label THEN 1 ELSE 0 END AS p FROM s)
  SELECT n // 100 AS batch_id, n % 100 // 25 AS sub_id, CAST(c AS INTEGER) AS class, CAST(j AS INTEGER) AS place, round(sum(p * v[j + 1]) / count(*), 8) AS gradient FROM p, (SELECT unnest(range({WIDTH + 1})) AS j) q GROUP BY ALL""")
def q80(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    out = learning.chunk_gradients(relational.chunked(e, [F.col("vec_id")], 100, 25), model(), ["batch_id", "sub_id"])
    return out.withColumn("gradient", F.round("gradient", 8))


@query("q81_predicted_vote", f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  w AS (SELECT c, list({_WEIGHT} ORDER BY j) AS w FROM (SELECT unnest(range({CLASSES})) AS c) a, (SELECT unnest(range({WIDTH})) AS j) b GROUP BY c),
  p AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(v, w) + {_BIAS} DESC, c) AS n, c FROM e, w)
  SELECT vec_id // 5 AS tree, CASE WHEN count(*) FILTER (WHERE c >= 5) > count(*) FILTER (WHERE c < 5) THEN 'live' ELSE 'dead' END AS status FROM p WHERE n = 1 GROUP BY 1""")
def q81(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 5").alias("tree"), F.col("embedding").alias("vector"))
    out = learning.predicted(e, model()).where("failure is null").withColumn("vote", (F.col("predicted") >= 5).cast("int"))
    return aggregates.majority(out, "tree", "vote", "live", "dead")


TRIALS = 100_000


@query("q82_split_search", spatial_queries.split_scores(TRIALS) + " SELECT trial, round(sum(gap * gap), 9) AS score, CAST(sum(nv) AS BIGINT) AS n_val FROM g GROUP BY trial HAVING sum(gap * gap) IS NOT NULL ORDER BY round(sum(gap * gap), 9), trial LIMIT 1")
def q82(spark: SparkSession, d: str) -> DataFrame:
    plots = table(spark, d, "supplier").select(F.col("s_suppkey").alias("plot"), (1 + F.col("s_suppkey") % 3).alias("weight"))
    counts = inputs.inventory(spark, d).groupBy("plot", "species").agg(F.count("*").alias("n"))
    return search.best_of_many(plots, counts, "plot", "weight", "species", "n", TRIALS)
