"""Window expressions over one ordered series per key.

All expressions of one Series share partitioning and order, so Catalyst plans them with one exchange and one sort
however many frames they use. A moving aggregate is NULL until its frame holds enough values that are not NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Series:
    """Columns over rows of one key in order."""

    def __init__(self, key: str = "stock_id", order: str = "date"):
        self.key, self.order = key, order

    @property
    def w(self):
        return Window.partitionBy(self.key).orderBy(self.order)

    @property
    def so_far(self):
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def before(self):
        return self.w.rowsBetween(Window.unboundedPreceding, -1)

    def last(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def number(self) -> Column:
        return F.row_number().over(self.w)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(col(c), n).over(self.w)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(col(c), n).over(self.w)

    def _moving(self, f, c, n: int, least: int | None) -> Column:
        frame, least = self.last(n), n if least is None else least
        value = f(col(c)).over(frame)
        return value if least <= 1 else F.when(F.count(col(c)).over(frame) >= least, value)

    def mean(self, c, n: int, least: int | None = None) -> Column:
        return self._moving(F.avg, c, n, least)

    def std(self, c, n: int, least: int | None = None) -> Column:
        return self._moving(F.stddev_samp, c, n, least)

    def min(self, c, n: int, least: int | None = None) -> Column:
        return self._moving(F.min, c, n, least)

    def max(self, c, n: int, least: int | None = None) -> Column:
        return self._moving(F.max, c, n, least)

    def change(self, c, n: int) -> Column:
        return col(c) - self.lag(c, n)

    def pct(self, c, n: int) -> Column:
        """Relative change; NULL where the old value is zero or missing."""
        return F.try_divide(col(c), self.lag(c, n)) - 1

    def z(self, c, n: int) -> Column:
        return F.try_divide(col(c) - self.mean(c, n), self.std(c, n))

    def rank_share(self, c, n: int, least: int) -> Column:
        """Share of the frame's values that are not above the current one; 0 where the current one is missing."""
        frame = self.last(n)
        values = F.collect_list(col(c)).over(frame)
        share = F.size(F.filter(values, lambda x: x <= col(c))) / F.count(col(c)).over(frame)
        return F.when(F.count(col(c)).over(frame) >= least, F.when(col(c).isNull(), 0.0).otherwise(share))


def flag(cond: Column) -> Column:
    """0/1; unknown is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")
