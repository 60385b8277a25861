"""Row order of a written catalogue: along a space-filling curve through x, y, z_cart.

Rows near each other in space lie near each other in the files, so the minima and
maxima of a Parquet row group bound a small box, and a filter on a box of space
(``view.frustum_bounds``) reads only the row groups that reach into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half the side of the cube that the curve fills, beyond the distance of redshift 5 in Mpc; what lies outside takes its nearest cell.
HALF = 8192.0
BITS = 10


def _spread(n: Column) -> Column:
    """The low ten bits of ``n``, two zero bits between each two."""
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


def curve_key(x="x", y="y", z="z_cart") -> Column:
    """Place on the Morton curve over 2^10 cells a side."""
    cells = 1 << BITS

    def cell(c) -> Column:
        at = F.floor((F.col(c).cast("double") + F.lit(HALF)) * F.lit(cells / (2 * HALF)))
        return F.least(F.greatest(at, F.lit(0)), F.lit(cells - 1)).cast("int")

    a, b, c = (_spread(cell(v)) for v in (x, y, z))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


#: Rows that one task sorts: some 100 MB of the widest catalogue, held in memory however large the table is.
TASK_ROWS = 1 << 19


def curve_ordered(df: DataFrame, partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """The rows range-partitioned and sorted along the curve (one shuffle); rows of one cell may part at any task.

    Unless given, the partitions are as many as the session's, or more for a larger table: they
    grow in number, not in size, so that no task's sort spills.  ``rows``: how many there are,
    or a bound, where that is known; else they are counted.  The keys are not shuffled: a task
    computes them again.
    """
    n = partitions
    if n is None:
        rows = df.count() if rows is None else rows
        n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    # rows of one cell, however many, are spread by a second key
    keys = {"_curve": curve_key(), "_fine": F.xxhash64("x", "y", "z_cart")}
    ranges = df.repartitionByRange(n, *keys.values())
    return ranges.withColumns(keys).sortWithinPartitions(*keys).drop(*keys)
