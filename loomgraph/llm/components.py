"""Connected components of an edge table, without ever gathering it in one place.

Every round contracts: each node points at the smallest of itself and its neighbours, pointers are
followed to their ends by doubling, edges are rewritten to the ends, and edges within a node
vanish.  Any node with a smaller neighbour disappears, so the rounds are logarithmic, and so are
the doublings of each.  Rounds are checkpointed to the shared folder.  A node that very many others
point at is dealt into parts when it is looked up (``salts``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import checkpointed


#: Rows of one key that a single task takes in a join; they are a few dozen bytes each.
ROWS_A_TASK = 4 << 20


def salts(rows: int) -> int:
    """Into how many parts a key must be dealt so that, even if it holds all rows, a task gets about ROWS_A_TASK of them."""
    return max(1, -(-rows // ROWS_A_TASK))


def dealt_join(rows: DataFrame, table: DataFrame, on: list[str], parts: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each value of ``on``; rows of one value are dealt into ``parts``.

    The entry of a value is first joined to the distinct (value, salt) of the rows, at most ``parts`` for a value.
    """
    if parts == 1:
        return rows.join(table, on, how)
    own = rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    return own.join(own.select(*on, "_s").distinct().join(table, on), [*on, "_s"], how).drop("_s")


def _looked_up(rows: DataFrame, column: str, table: DataFrame, parts: int) -> DataFrame:
    """``rows`` with ``column`` replaced by its entry in table (node, to), or left as it is."""
    t = table.select(F.col("node").alias(column), F.col("to").alias("_to"))
    return dealt_join(rows, t, [column], parts, "left").withColumn(column, F.coalesce("_to", column)).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b)."""
    pairs = lambda e: checkpointed(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, found = pairs(edges), None
    parts = salts(2 * left.count())  # there are no more nodes than ends of edges
    while not left.isEmpty():
        both = left.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("to")))
        step = checkpointed(both.groupBy("node").agg(F.min("to").alias("to")))
        while True:  # a chain of pointers halves with every turn; most are stars, which one turn confirms
            jump = checkpointed(_looked_up(step.withColumn("was", F.col("to")), "to", step, parts))
            if jump.where("was <> to").isEmpty():
                break
            step = jump.select("node", "to")
        left = pairs(_looked_up(_looked_up(left, "a", step, parts), "b", step, parts))
        # every end of an edge that is left is what some node points at, so the nodes stay the same
        found = checkpointed(step if found is None else _looked_up(found, "to", step, parts))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return found.select("node", F.col("to").alias("component"))
