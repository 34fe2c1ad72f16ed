"""Split the groups of a candidate key so that no task gets an unbounded one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_groups(rows: DataFrame, key: list[str], order: str, chunk: int, load: str | None = None, most: int = 0) -> DataFrame:
    """Rows of groups of two or more, each dealt to tasks of at most 2 * chunk rows or so.

    A group of up to ``chunk`` rows stays one. A larger one is dealt by a hash
    of ``order`` to k parts, and each pair of parts (p <= q) is a task, so that
    any two rows still meet: in (p, q) if they are in different parts, and in
    (p, p) if in the same. With ``load`` (a column) its sum over a part is
    bounded by ``most``, too, or so. Adds the columns p, q (the task) and side
    (the row's part). Nothing is dropped.
    """
    k = F.ceil(F.count("*") / chunk)
    if load:
        k = F.greatest(k, F.ceil(F.sum(load) / most))
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"), k.cast("int").alias("_parts")).where("_n > 1")
    rows = rows.join(sizes, key)
    k = F.col("_parts")
    rows = rows.withColumn("_k", k).withColumn("side", F.pmod(F.xxhash64(order), k.cast("long")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: F.struct(F.least("side", o).alias("p"), F.greatest("side", o).alias("q")))
    return rows.withColumn("_t", F.explode(tasks)).select(*[c for c in rows.columns if c not in ("_n", "_parts", "_k")], "_t.p", "_t.q")


class Forest:
    """Union-find over a task's rows; keeps edges that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Add the edges x[i]-y[i]; all but a spanning forest are forgotten."""
        while True:
            a, b = self.root[x], self.root[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            # One edge for each higher root, to its least lower one: no cycles.
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
            self.edges += zip(x[first].tolist(), y[first].tolist(), strict=True)
            up = np.arange(len(self.root))
            up[high[first]] = low[first]
            while True:
                again = up[up]
                if (again == up).all():
                    break
                up = again
            self.root = up[self.root]
