"""Which tables are small enough to be sent to all executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of a table that is sent, in rows and in bytes of its values.
ROWS, BYTES = 1_000_000, 64 << 20


def small(table: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """``table``, marked for broadcast if it is within the bounds; beyond them a join with it shuffles."""
    wide = [c for c, kind in table.dtypes if kind in ("string", "binary")]
    fixed = 16 * (len(table.columns) - len(wide))
    n, written = table.agg(F.count("*"), F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(fixed)))).first()
    return F.broadcast(table) if n <= rows and (written or 0) <= size else table
