"""Report period and the two period predicates.

F1 ``in_period``: ``d BETWEEN start AND end + 1 day`` with both ends
inclusive, so midnight of the day after ``end`` belongs to the period.

F2 ``in_period_by_day``: the receivable reports compare a *day-truncated*
date with the same bounds, which admits the whole day after ``end``. It is
written on the raw column as ``d >= start AND d < end + 2 days`` so the
predicate stays sargable and reaches the parquet scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T


def _ts_literal(value: dt.datetime) -> Column:
    # A typed NTZ literal: compares with TIMESTAMP_NTZ columns without a cast
    # on the column side, so the filter is pushed into the scan.
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast(T.TimestampNTZType())


@dataclass(frozen=True)
class Period:
    start: dt.date
    end: dt.date

    @classmethod
    def parse(cls, start: str, end: str) -> "Period":
        return cls(dt.date.fromisoformat(start), dt.date.fromisoformat(end))

    @property
    def start_ts(self) -> dt.datetime:
        return dt.datetime.combine(self.start, dt.time())

    @property
    def end_inclusive_ts(self) -> dt.datetime:
        """Upper bound of F1 (inclusive): midnight after ``end``."""
        return dt.datetime.combine(self.end + dt.timedelta(days=1), dt.time())

    @property
    def end_by_day_exclusive_ts(self) -> dt.datetime:
        """Upper bound of F2 (exclusive): midnight two days after ``end``."""
        return dt.datetime.combine(self.end + dt.timedelta(days=2), dt.time())

    @property
    def label(self) -> str:
        return f"{self.start.isoformat()}__{self.end.isoformat()}"


def in_period(col: Column | str, period: Period) -> Column:
    """inclusive ``BETWEEN start AND end + 1 day``."""
    c = F.col(col) if isinstance(col, str) else col
    return c.between(_ts_literal(period.start_ts), _ts_literal(period.end_inclusive_ts))


def in_period_by_day(col: Column | str, period: Period) -> Column:
    """the day of ``col`` lies in ``[start, end + 1 day]``."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= _ts_literal(period.start_ts)) & (c < _ts_literal(period.end_by_day_exclusive_ts))


# Test period of the oracle checks (chosen to trigger the boundary quirks).
TEST_PERIOD = Period(dt.date(1997, 1, 1), dt.date(1997, 1, 20))
