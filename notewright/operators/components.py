"""H1, H2: connected components of an edge table.

Large-star and small-star steps alternate (Kiveris et al., Connected Components in MapReduce and
Beyond, 2014): every round is two joins on vertex keys, which Spark can split where a vertex has
very many edges, and the number of rounds grows with the logarithm of the longest path. Each
round's edges are written to the shared folder, so the plan stays short and a lost executor costs
a file read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.storage import discard, materialize


#: Edges in a written part: rounds over few edges, which are most rounds, are a handful of tasks whatever the shuffles' partitions.
PART_EDGES = 200_000


def _written(edges: DataFrame, n: int, name: str = "components") -> DataFrame:
    """The edges, written in as many parts as n rows need."""
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 + n // PART_EDGES
    return materialize(edges.coalesce(parts) if parts < most else edges, name)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each larger neighbour of a vertex is tied to the least of the vertex and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    # Written first, so that the join below deals both sides anew and Spark can split a vertex of very many edges.
    least = _written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n, "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are tied to the least of them; edges point from larger to smaller."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select("v", "m").union(least.select("u", "m")).toDF("u", "v")


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """node, component: the component's least node, for every node of edges and vertices.

    edges: two columns of one orderable type, in any direction, repeats and loops allowed; rows
    with a null are left out. vertices: one column of that type; nodes without an edge are their
    own component. No edges give one component per vertex.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select("u").union(pairs.select("v"))
    if vertices is not None:
        nodes = nodes.union(vertices.select(vertices.columns[0]).where(F.col(vertices.columns[0]).isNotNull()))
    now = materialize(_distinct(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "components")
    while True:
        n, stars = _stars(now)
        if stars:
            break
        half = _written(_large_star(now, n), n)
        then = _written(_distinct(_small_star(half)), n)
        discard(now, half)
        now = then
    return nodes.distinct().withColumnRenamed("u", "node").join(now.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they (larger to smaller) are stars around their least vertices: no vertex has two others below it, or one below and one above."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    most, n = each.agg(F.coalesce(F.max(F.col("below") + F.least("below", "above")), F.lit(0)), F.coalesce(F.sum("below"), F.lit(0))).first()
    return n, most <= 1


def threshold_sweep(edges: DataFrame, vertices: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold double, n_components long: components of the edges with probability at or above each threshold.

    Thresholds are taken from the highest down; each adds its edges, contracted to the components
    found so far, so no edge is walked twice.
    """
    spark = edges.sparkSession
    labels = materialize(vertices.select(F.col(vertices.columns[0]).alias("node")).distinct().withColumn("component", F.col("node")), "sweep")
    rows, above = [], None
    for t in sorted(set(thresholds), reverse=True):
        fresh = edges.where(F.col("probability") >= t)
        if above is not None:
            fresh = fresh.where(F.col("probability") < above)
        a, b = edges.columns[:2]
        tied = (
            fresh.join(labels.select(F.col("node").alias(a), F.col("component").alias("ca")), a)
            .join(labels.select(F.col("node").alias(b), F.col("component").alias("cb")), b)
            .where("ca <> cb")
            .select("ca", "cb")
        )
        merged = connected_components(tied).toDF("component", "root")
        labels = materialize(labels.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "sweep")
        rows.append((float(t), labels.select("component").distinct().count()))
        above = t
    return spark.createDataFrame(rows, "threshold double, n_components long")
