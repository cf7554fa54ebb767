"""Ordered work over groups of any size.

A window over one group sorts that group in one task. Here the rows are cut by
range into runs that follow each other in the given order, so a group may span
many runs; windows work inside a run, and one row per run carries values across
the borders. Runs are written to reliable storage first, so every reader sees the
same borders even when tasks are repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendwell.session import checkpointed

RUN = "run"


def in_runs(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in ascending ``(group, order)`` ranges, numbered by the column ``run``."""
    ranged = df.repartitionByRange(*group, *order)
    return checkpointed(ranged.withColumn(RUN, F.spark_partition_id()))


def neighbour(
    runs: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    step: int = -1,
) -> DataFrame:
    """Add ``near_<column>`` from the row before (step -1) or after (step 1) in its group."""
    back = step < 0
    sort = [F.col(c).asc() if back else F.col(c).desc() for c in order]
    window = Window.partitionBy(RUN, *group).orderBy(*sort)
    key = F.struct(*group, *order)
    border_row = F.struct(*group, *columns)
    border = (F.max_by if back else F.min_by)(border_row, key)
    run_order = F.col(RUN).asc() if back else F.col(RUN).desc()
    # One row per run, so this unpartitioned window stays as small as the run count.
    borders = runs.groupBy(RUN).agg(border.alias("border")).select(
        RUN, F.lag("border").over(Window.orderBy(run_order)).alias("border")
    )
    same_group = F.col("border").isNotNull()
    for name in group:
        same_group = same_group & F.col(f"border.{name}").eqNullSafe(F.col(name))
    at_border = (F.col("place") == 1) & same_group
    inside = runs.withColumn("place", F.row_number().over(window)).withColumns(
        {f"near_{c}": F.lag(c).over(window) for c in columns}
    )
    return (
        inside.join(F.broadcast(borders), RUN)
        .withColumns(
            {f"near_{c}": F.when(at_border, F.col(f"border.{c}")).otherwise(F.col(f"near_{c}")) for c in columns}
        )
        .drop("border", "place")
    )


def running_totals(
    runs: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column]
) -> DataFrame:
    """Add an inclusive running sum and ``all_<name>``, the group's total, for every sum."""
    per_run = runs.groupBy(RUN, *group).agg(
        *[F.coalesce(F.sum(column), F.lit(0)).alias(f"part_{name}") for name, column in sums.items()]
    )
    # One row per run and group it touches; a group's window holds one row per run.
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_run.select(
        RUN,
        *group,
        *[F.coalesce(F.sum(f"part_{n}").over(before), F.lit(0)).alias(f"base_{n}") for n in sums],
        *[F.sum(f"part_{n}").over(whole).alias(f"all_{n}") for n in sums],
    )
    window = (
        Window.partitionBy(RUN, *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = runs.withColumns({n: F.sum(c).over(window) for n, c in sums.items()})
    same = [summed[RUN] == offsets[RUN]] + [summed[g].eqNullSafe(offsets[g]) for g in group]
    kept = [summed[c] for c in summed.columns if c not in sums]
    return summed.join(offsets, same).select(
        *kept,
        *[(F.coalesce(summed[n], F.lit(0)) + offsets[f"base_{n}"]).alias(n) for n in sums],
        *[offsets[f"all_{n}"] for n in sums],
    )


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``position`` (from 1) and ``all_position`` (the group's size)."""
    runs = in_runs(df, group, order)
    return running_totals(runs, group, order, {"position": F.lit(1)}).drop(RUN)
