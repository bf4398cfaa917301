"""Graphs of nodes (id, kind) and edges (source, target, source_kind, target_kind) as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem, subject for everything that is wrong: duplicate ids, dangling ends, ends of different kinds (Any fits all), self loops."""
    twice = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("problem"), F.col("id").alias("subject"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    dangling = ends.join(nodes, "id", "left_anti").distinct().select(F.lit("dangling_end").alias("problem"), F.col("id").alias("subject"))
    kinds = edges.where("source_kind <> target_kind and source_kind <> 'Any' and target_kind <> 'Any'").select(F.lit("kind_mismatch").alias("problem"), F.concat_ws(">", "source", "target").alias("subject"))
    loops = edges.where("source = target").select(F.lit("self_loop").alias("problem"), F.col("source").alias("subject"))
    return twice.unionByName(dangling).unionByName(kinds).unionByName(loops)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and level: the longest path from a node without inputs. Nodes on or behind a cycle have none. Plan-sized tables; a round for each level."""
    spark = nodes.sparkSession
    nodes.select("id").distinct().createOrReplaceTempView("_graph_nodes")
    edges.select("source", "target").distinct().createOrReplaceTempView("_graph_edges")
    count = nodes.select("id").distinct().count()
    walked = spark.sql(f"""
        WITH RECURSIVE walk(id, level) MAX RECURSION LEVEL {count + 1} AS (
            SELECT n.id, 0 FROM _graph_nodes n LEFT ANTI JOIN _graph_edges e ON e.target = n.id
            UNION ALL
            SELECT e.target, w.level + 1 FROM walk w JOIN _graph_edges e ON e.source = w.id WHERE w.level < {count})
        SELECT id, max(level) AS level FROM walk GROUP BY id""")
    return walked.where(F.col("level") < count).select("id", F.col("level").cast("long").alias("level"))


def kind_counts(nodes: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """Node kinds whose number differs from the one a shape asks for: kind, n, wanted."""
    plan = nodes.sparkSession.createDataFrame(list(wanted.items()), "kind string, wanted long")
    found = nodes.groupBy("kind").agg(F.count("*").alias("n"))
    return plan.join(found, "kind", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> wanted").select("kind", "n", "wanted")
