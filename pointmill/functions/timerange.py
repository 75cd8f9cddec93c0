"""Time predicates as closed ranges [t0, t1] of nanoseconds; None is unbounded."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.errors import EngineError


def nanoseconds(t: int | str | None) -> int | None:
    """A count of ns, or a time such as 2024-01-01T00:00:00.5Z, which may have up to nine decimals."""
    if t is None or isinstance(t, int):
        return t
    body, dot, rest = t.strip().rstrip("Zz").partition(".")
    try:
        whole = datetime.fromisoformat(body).replace(tzinfo=timezone.utc)
        return int(whole.timestamp()) * 10**9 + (int((rest + "0" * 9)[:9]) if dot else 0)
    except ValueError as e:
        raise EngineError("INVALID_ARGUMENT", f"time {t!r}") from e


@dataclass(frozen=True)
class TimeRange:
    t0: int | None = None
    t1: int | None = None

    @classmethod
    def between(cls, t0=None, t1=None) -> "TimeRange":
        return cls(nanoseconds(t0), nanoseconds(t1))

    @classmethod
    def compared(cls, op: str, t) -> "TimeRange":
        """time_ns op T."""
        t = nanoseconds(t)
        made = {"<": (None, t - 1), "<=": (None, t), "==": (t, t), ">=": (t, None), ">": (t + 1, None)}
        if op not in made:
            raise EngineError("INVALID_COMMAND", f"operator {op!r}")
        return cls(*made[op])

    @classmethod
    def framed(cls, t0, low: str, high: str, t1) -> "TimeRange":
        """T0 low time_ns high T1, both < or <=."""
        if low not in ("<", "<=") or high not in ("<", "<="):
            raise EngineError("INVALID_COMMAND", f"operators {low!r} {high!r}")
        return cls(nanoseconds(t0) + (low == "<"), nanoseconds(t1) - (high == "<"))

    def apply(self, df: DataFrame, column: str = "time_ns") -> DataFrame:
        """Plain comparisons on the stored column, which reach the Parquet scan as filters."""
        if self.t0 is not None:
            df = df.where(F.col(column) >= F.lit(self.t0).cast("long"))
        if self.t1 is not None:
            df = df.where(F.col(column) <= F.lit(self.t1).cast("long"))
        return df
