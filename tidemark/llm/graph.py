"""Connected components by repeated contraction, all state in tables.

Each round every node points at its smallest neighbour (or itself), pointers
are doubled, and edges are rewritten to pointers with loops and repeats
dropped. A hub costs its map-side combined minimum and a join partition that
AQE can split; nothing is gathered per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, keep


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each node of ``edges`` (a, b): root is the smallest id reachable."""
    edges = keep(_tidy(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p"))
        hook = keep(hook, "hooks")
        twice = keep(_through(hook, hook, "p"), "hooks")
        far = keep(_through(twice, twice, "p"), "hooks")
        one = _through(edges.select(F.col("a").alias("id"), F.col("b").alias("p")), far, "p").select(F.col("id").alias("p"), F.col("p").alias("id"))
        fewer = keep(_tidy(_through(one, far, "p").select(F.col("id").alias("a"), F.col("p").alias("b"))), "edges")
        roots_now = far if roots is None else keep(_through(roots, far, "p"), "roots")
        old = [edges, hook, twice] + ([] if roots is None else [roots, far])
        edges, roots = fewer, roots_now
        for x in old:
            discard(x)
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.select("id", F.col("p").alias("root"))


def _tidy(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct()


def _through(rows: DataFrame, pointers: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced by what ``pointers`` (id, p) say of it."""
    to = pointers.select(F.col("id").alias("_id"), F.col("p").alias("_p"))
    return rows.join(to, rows[column] == to["_id"], "left").withColumn(column, F.coalesce("_p", column)).drop("_id", "_p")
