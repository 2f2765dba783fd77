"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import written

#: Rows of two or three numbers that a file of edges or labels holds at least, where there are as many.
ROWS_PER_FILE = 500_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the least id of the component, for every id that occurs in ``edges`` (a, b).

    Each round takes the least label among the neighbours and then the label of that label, so long chains shrink by
    powers. Labels are written to the shared folder each round. Loops and repeated edges do no harm; null ends are
    left out; an empty table has no components.
    """
    e = edges.select("a", "b").where("a is not null and b is not null")
    rows = 2 * e.count()
    both = written(e.union(e.select("b", "a")).distinct(), "cc-edges", rows, ROWS_PER_FILE)
    label = written(both.groupBy(F.col("a").alias("id")).agg(
        F.least(F.min("a"), F.min("b")).alias("root")), "cc-label", rows, ROWS_PER_FILE)
    for _ in range(rounds):
        near = both.join(label.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("root").alias("near"))
        step = label.join(near, "id").select("id", "root", F.least("root", "near").alias("next"))
        jump = label.select(F.col("id").alias("next"), F.col("root").alias("far"))
        new = written(step.join(jump, "next").select(
            "id", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved")),
            "cc-label", rows, ROWS_PER_FILE)
        label = new.select("id", "root")
        if not new.where("moved").limit(1).count():
            return label
    raise RuntimeError(f"components have not settled in {rounds} rounds")
