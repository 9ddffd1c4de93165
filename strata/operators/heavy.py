"""Exact most frequent levels (D3, Q9 text, T6) from bounded summaries.

1. Each task counts a column's levels in a table of at most ``CAPACITY`` entries; when it is
   full, the (capacity + 1)-th largest count is taken off all of them (Misra–Gries), and what was taken
   is the task's error: no level's count is short by more. Summaries add up, errors too.
2. A column whose error is 0 is counted exactly by that. Else let t be the k-th largest summed
   count: a level outside all summaries has at most ``error`` rows. If t is larger than that, the k most
   frequent levels are among those whose count + error reaches t, and only they are counted again,
   exactly, by a second scan.
3. Where the bound proves nothing (levels about equally frequent, such as all distinct ones), the
   column's whole frequency table is built.

So a skewed column with very many levels shuffles its summaries and a few candidates, never all
levels. The result is exact in all three cases: count descending, level ascending.
"""
from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import present
from ..session import staged
from .stats import ranked, value_freq

CAPACITY, FEW = 8192, 50_000


def _shrunk(table: dict[str, int], capacity: int) -> tuple[dict[str, int], int]:
    """The table cut back to ``capacity`` entries, and what was taken off every count."""
    off = int(np.partition(np.fromiter(table.values(), np.int64, len(table)), len(table) - capacity - 1)[len(table) - capacity - 1])
    return {v: n - off for v, n in table.items() if n > off}, off


def _summaries(width: int, capacity: int):
    def run(batches):
        tables: list[dict[str, int]] = [{} for _ in range(width)]
        errors = [0] * width
        for batch in batches:
            for c in range(width):
                table = tables[c]
                for entry in pc.value_counts(batch.column(c).drop_null()).to_pylist():
                    table[entry["values"]] = table.get(entry["values"], 0) + entry["counts"]
                if len(table) > 2 * capacity:
                    tables[c], off = _shrunk(table, capacity)
                    errors[c] += off
        for c in range(width):
            if len(tables[c]) > capacity:
                tables[c], off = _shrunk(tables[c], capacity)
                errors[c] += off
            values, counts = [*tables[c], None], [*tables[c].values(), errors[c]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), c, np.int32)), pa.array(values, pa.string()), pa.array(counts, pa.int64())], ["c", "value", "n"])

    return run


def top_levels(df: DataFrame, columns: Sequence[str], k: int, capacity: int = CAPACITY) -> DataFrame:
    """(column, value, n, rank): the ``k`` most frequent non-missing levels of every column, as STRING."""
    cols = list(columns)
    text = df.select(*[present(df, c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)])
    summed = staged(text.mapInArrow(_summaries(len(cols), capacity), "c int, value string, n long").groupBy("c", "value").agg(F.sum("n").alias("n")), "levels")
    levels = summed.where(F.col("value").isNotNull())
    # no k-th count where the summaries hold fewer levels
    best = Window.partitionBy("c").orderBy(F.desc("n"), "value")
    kth = levels.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).groupBy("c").agg(F.when(F.count("*") == k, F.min("n")).alias("kth"))
    errors = summed.where(F.col("value").isNull()).select("c", F.col("n").alias("error")).join(kth, "c", "left")
    proof = {r["c"]: (r["error"], r["kth"]) for r in errors.collect()}  # one row per column
    exact = [c for c, (error, _) in proof.items() if error == 0]
    proven = {c: (error, t) for c, (error, t) in proof.items() if error and t is not None and t > error}
    unproven = [c for c in proof if c not in exact and c not in proven]
    found = levels.where(F.col("c").isin(exact)) if exact else levels.limit(0)
    if proven:
        cut = F.create_map(*[F.lit(x) for c, (error, t) in proven.items() for x in (c, t - error)])[F.col("c")]
        wanted = staged(levels.where(F.col("n") >= cut).select("c", "value"), "candidates")
        wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"v{c}").alias("value")) for c in proven])
        again = text.select(F.inline(cells)).where(F.col("value").isNotNull()).join(wanted, ["c", "value"]).groupBy("c", "value").agg(F.count("*").alias("n"))
        found = found.unionByName(again)
    if unproven:
        names = F.create_map(*[F.lit(x) for c in unproven for x in (cols[c], c)])[F.col("column")]
        whole = value_freq(df, [cols[c] for c in unproven]).select(names.alias("c"), "value", "n")
        found = found.unionByName(whole)
    top = ranked(found, ["c"]).where(F.col("rank") <= k)
    return top.select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c") + 1).alias("column"), "value", "n", "rank")
