"""Connected components of a link table, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.store import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): component is the smallest id reachable. Empty links give no rows.

    Each round an id takes the smallest component among its own and its neighbours', then the component of that id, so
    that distances halve; it ends when nothing gets smaller. No step gathers an id's neighbours: each needs only their
    minimum, and the joins read written tables on both sides, so an id with very many neighbours can be split.
    """
    pairs = links.where("a != b").select("a", "b").distinct()
    both = written(pairs.union(pairs.select("b", "a")), "links")
    start = F.least(F.col("a"), F.min("b"))
    labels = written(both.groupBy("a").agg(start.alias("component")).withColumnRenamed("a", "id"), "labels")
    before = None
    while True:
        heard = both.join(labels.toDF("b", "component"), "b").select(F.col("a").alias("id"), "component")
        nearer = written(heard.union(labels).groupBy("id").agg(F.min("component").alias("component")), "nearer")
        heads = nearer.toDF("component", "head")
        jumped = nearer.join(heads, "component").select("id", F.col("head").alias("component"))
        labels = written(jumped, "labels")
        total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("t")).first()["t"]
        if total == before:
            return labels
        before = total
