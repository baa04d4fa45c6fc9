"""Batches of an import: positions in a batch, and batches of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise, ranked


def batch_index(rows: DataFrame, batch: str, order: str) -> DataFrame:
    """rows with data_index, 0 to n - 1 in each batch. A batch is numbered in ranges of its order, so a large one has many tasks."""
    return ranked(rows, (batch,), (order,), "data_index")


def size_batches(rows: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """(group, order, batch_no): rows of a group are gathered in order until their sizes exceed limit; the row that exceeds it closes its batch.

    Where a batch closes depends on every row before, but a run of rows only needs to know the sum at
    which the last batch before it closed. So the rows of a group are cut into runs. Each run tells,
    for every row of its first `limit` that may be the first to close a batch, at which sum its last
    batch closes. One pass over these few rows leads from run to run, and then each run numbers its
    own rows.
    """
    rows = rows.select(F.col(group).cast("string").alias("g"), F.col(order).cast("long").alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s"))
    dealt = materialise(rows.repartitionByRange("g", "o").withColumn("run", F.spark_partition_id()))
    of_run = dealt.groupBy("g", "run").agg(F.sum("s").alias("_all"))
    of_run = of_run.select(F.col("g").alias("_g"), F.col("run").alias("_run"), (F.sum("_all").over(Window.partitionBy("g").orderBy("run")) - F.col("_all")).alias("start"))
    same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("run") == F.col("_run"))
    dealt = materialise(dealt.join(of_run, same).select("g", "run", "start", "o", "s"))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        sums = pdf.start.iloc[0] + pdf.s.to_numpy().cumsum()
        at = np.arange(len(sums))
        after = np.searchsorted(sums, sums + limit, "right")  # the row that closes the batch after the one that a row closes
        last, closed, step = np.where(after < len(sums), after, at), (after < len(sums)) + 1, 0
        while step < len(sums).bit_length():
            closed, last, step = np.where(last != at, closed + closed[last] - 1, closed), last[last], step + 1
        first = at[: 1 + int(np.searchsorted(sums, pdf.start.iloc[0] + limit, "right"))]
        return pd.DataFrame({"g": pdf.g.iloc[0], "run": pdf.run.iloc[0], "sum": sums[first], "last": sums[last[first]], "closed": closed[first]})

    def follow(batches):
        g, run, at, closed, begun = None, None, 0, 0, False
        for pdf in batches:
            out = []
            for x in pdf.itertuples(index=False):
                if not begun or x.g != g:
                    g, run, at, closed, begun = x.g, None, 0, 0, True
                if x.run != run:
                    run, open_ = x.run, True
                    out.append((g, run, at, closed))
                if open_ and x.sum > at + limit:
                    at, closed, open_ = x.last, closed + x.closed, False
            yield pd.DataFrame(out, columns=["_g", "_run", "at", "before"])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        sums, at, ends = pdf.start.iloc[0] + pdf.s.to_numpy().cumsum(), int(pdf["at"].iloc[0]), []
        while (k := int(np.searchsorted(sums, at + limit, "right"))) < len(sums):
            at = int(sums[k])
            ends.append(at)
        no = pdf.before.iloc[0] + np.searchsorted(ends, sums - pdf.s.to_numpy(), "right")
        return pd.DataFrame({group: pdf.g, order: pdf.o, "batch_no": no})

    found = dealt.groupBy("g", "run").applyInPandas(summary, "g string, run int, sum long, last long, closed long")
    entries = materialise(found.repartition("g").sortWithinPartitions("g", "run", "sum").mapInPandas(follow, "_g string, _run int, at long, before long"))
    return dealt.join(entries, same).select("g", "run", "start", "o", "s", "at", "before").groupBy("g", "run").applyInPandas(number, f"{group} string, {order} long, batch_no long")


def group_sizes(rows: DataFrame, group: str, size: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("total"))
