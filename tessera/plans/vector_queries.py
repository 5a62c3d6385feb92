"""Vector queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.functions import vectors as V
from tessera.plans.registry import query
from tessera.session import table

E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
AXIS = """parts AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i, label % 2 AS side FROM e),
    means AS (SELECT i, avg(x) FILTER (side = 1) - avg(x) FILTER (side = 0) AS d FROM parts GROUP BY i),
    axis AS (SELECT list(d ORDER BY i) AS raw FROM means), unit_axis AS (SELECT list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS a FROM axis)"""


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.double(F.col("embedding")).alias("v"))


def axis(found: DataFrame) -> DataFrame:
    """One row: the unit vector from the mean of even labels to the mean of odd ones."""
    side = F.col("label") % 2
    parts = found.select(side.alias("side"), F.posexplode("v").alias("i", "x"))
    means = parts.groupBy("i").agg((F.avg(F.when(F.col("side") == 1, F.col("x"))) - F.avg(F.when(F.col("side") == 0, F.col("x")))).alias("d"))
    # one row per dimension
    raw = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "d"))), lambda p: p["d"]).alias("raw"))
    return raw.select(V.unit(F.col("raw")).alias("axis"))


@query("vector_unit", f"WITH {E} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e")
def vector_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedded(spark, sf_dir)
    total = F.aggregate(V.unit(F.col("v")), F.lit(0.0), lambda s, x: s + x)
    return found.select("vec_id", F.round(total, 6).alias("total"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@query("axis_projection", f"WITH {E}, {AXIS} SELECT vec_id, round(list_dot_product(v, a), 5) AS along, round(list_dot_product(v, v) - power(list_dot_product(v, a), 2), 5) AS rest FROM e, unit_axis")
def axis_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's part along the axis between label groups and the squared length of its residual."""
    found = embedded(spark, sf_dir)
    held = found.crossJoin(F.broadcast(axis(found)))  # one row of as many numbers as dimensions
    rest = V.residual(F.col("v"), F.col("axis"))
    return held.select("vec_id", F.round(V.dot(F.col("v"), F.col("axis")), 5).alias("along"), F.round(V.dot(rest, rest), 5).alias("rest"))


@query(
    "group_projection",
    f"WITH {E}, {AXIS} SELECT label, count(*) AS n, round(avg(list_dot_product(v, a)), 5) AS mean, count(*) FILTER (list_dot_product(v, a) > 0) AS ahead FROM e, unit_axis GROUP BY label",
)
def group_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedded(spark, sf_dir)
    held = found.crossJoin(F.broadcast(axis(found))).select("label", V.dot(F.col("v"), F.col("axis")).alias("p"))
    return held.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("p"), 5).alias("mean"), F.count_if(F.col("p") > 0).alias("ahead"))


@query(
    "group_similarity",
    f"""WITH {E}, u AS (SELECT label, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS x, generate_subscripts(v, 1) AS i FROM e),
        s AS (SELECT label, i, sum(x) AS s FROM u GROUP BY label, i), n AS (SELECT label, count(*) AS n FROM e GROUP BY label)
        SELECT label, any_value(n) AS n, round((sum(s * s) - any_value(n)) / nullif(any_value(n) * (any_value(n) - 1), 0), 6) AS mean_cosine FROM s JOIN n USING (label) GROUP BY label""",
)
def group_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of all pairs of a label's vectors, from the sum of unit vectors: no pair is ever formed."""
    found = embedded(spark, sf_dir).select("label", F.posexplode(V.unit(F.col("v"))).alias("i", "x"))
    sums = found.groupBy("label", "i").agg(F.sum("x").alias("s"), F.count("*").alias("k"))
    per = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("k").alias("n"))
    return per.select("label", "n", F.round(F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


@query(
    "prototype_top5",
    f"""WITH {E}, c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i) GROUP BY label),
        s AS (SELECT e.label, vec_id, round(list_cosine_similarity(v, c), 6) AS cosine FROM e JOIN c USING (label))
        SELECT label, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def prototype_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to their label's mean."""
    found = embedded(spark, sf_dir)
    means = found.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("c"))
    near = found.join(centres, "label").select("label", "vec_id", F.round(V.cosine(F.col("v"), F.col("c")), 6).alias("cosine"))
    order = W.partitionBy("label").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5").select("label", "vec_id", "cosine", "rank")
