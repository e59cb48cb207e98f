"""Safe casts (PRJ-3, FN-15, FN-35).

``try_cast(text AS INT)`` in the reference engine rounds numeric text
('12.7' -> 13, '1e2' -> 100) while Spark returns NULL.  Plain integers are
cast as they are; a decimal fraction is taken apart at its point and rounded half
away from zero by its first digit alone, so no digit is lost and nothing is rounded
twice ('0.49999999999' -> 0).  Text with an exponent goes through a wide decimal.
Results are range-checked; garbage is NULL.  Hexadecimal text and digits grouped by
underscores are not taken as numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

_INT = (-(1 << 31), (1 << 31) - 1)
_LONG = (-(1 << 63), (1 << 63) - 1)
# Wide enough for a bigint with ten decimals before rounding.
_EXACT = "decimal(38,10)"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_cast_double(c: ColumnOrName) -> Column:
    return _col(c).try_cast("double")


# a sign, whole digits, a point and a fraction; whole digits or the fraction may be missing
_FRACTION = r"^\s*([+-]?)(\d*)\.(\d*)\s*$"


def _rounded(col: Column) -> Column:
    """Text with a fraction or an exponent as a whole decimal; NULL for other text."""
    negative, digits, fraction = (F.regexp_extract(col, _FRACTION, i) for i in (1, 2, 3))
    size = F.when(digits == "", F.lit("0")).otherwise(digits).try_cast("decimal(38,0)") + (F.substring(fraction, 1, 1) >= "5").cast("int")
    split = F.when(col.rlike(_FRACTION) & ((digits != "") | (fraction != "")), F.when(negative == "-", -size).otherwise(size))
    # text such as '1e2' is no decimal literal to try_cast in every engine: doubles are the last resort
    power = F.when(col.rlike("[eE]"), F.round(F.coalesce(col.try_cast(_EXACT), F.round(col.try_cast("double")).try_cast(_EXACT))))
    return F.coalesce(split.cast("decimal(38,0)"), power.cast("decimal(38,0)"))


def _whole(c: ColumnOrName, kind: str, bounds: tuple[int, int]) -> Column:
    col = _col(c)
    low, high = (F.lit(str(b)).cast("decimal(38,0)") for b in bounds)
    # the rare texts go through functions of an array of one: each step is computed once, and the code
    # generated for a row of plain numbers stays small enough for the JVM to compile it
    rare = F.transform(F.transform(F.array(col), _rounded), lambda x: F.when((x >= low) & (x <= high), x).cast(kind))
    return F.coalesce(col.try_cast(kind), rare.getItem(0))


def try_cast_int(c: ColumnOrName) -> Column:
    return _whole(c, "int", _INT)


def try_cast_long(c: ColumnOrName) -> Column:
    return _whole(c, "bigint", _LONG)


def text_ts(c: ColumnOrName) -> Column:
    """ISO-8601 text -> TIMESTAMP_NTZ, NULL on garbage.

    An explicit offset is dropped (wall clock kept), the same as the
    reference engine's ``try_cast(... AS TIMESTAMP)``.
    """
    return _col(c).try_cast("timestamp_ntz")
