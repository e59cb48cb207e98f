"""Hash surrogate keys (PRJ-6, FN-7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def surrogate_key(*cols: ColumnOrName) -> Column:
    """``md5(coalesce(str(c1),'') | '|' | coalesce(str(c2),'') ...)``.

    A NULL part becomes the empty string, so the key itself is never NULL.
    Only text, integer, date, timestamp and boolean parts are allowed
    callers should not hash doubles: their text form differs between engines.
    """
    parts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def md5_or_null(c: ColumnOrName) -> Column:
    """``md5(c)``: NULL in, NULL out (single-column key without coalesce)."""
    return F.md5(_col(c).cast("string"))


def assert_hashable(df, cols) -> None:
    """Reject floating point key parts (their text form is engine specific)."""
    for name in cols:
        if isinstance(name, str) and isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
            raise TypeError(f"surrogate key part {name!r} is floating point")
