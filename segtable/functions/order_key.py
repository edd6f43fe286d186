"""Order-preserving codes of values, and their interleaving for layout on several columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument

#: Bits of a code.
CODE_BITS = 64


def orderable(kind: T.DataType) -> bool:
    """Whether a column has an order that bounds and codes can follow; texts only in byte order."""
    if isinstance(kind, T.StringType) and not kind.isUTF8BinaryCollation():
        return False
    return isinstance(kind, (T.BooleanType, T.IntegralType, T.FractionalType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType))


def code(c: Column, kind: T.DataType) -> Column:
    """A long whose order as 64 unsigned bits is the value's; a null comes first."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = F.rpad(F.hex(F.substring(c.cast("binary"), 1, CODE_BITS // 8)), CODE_BITS // 4, "0")
        half = lambda at: F.conv(F.substring(raw, at, CODE_BITS // 8), 16, 10).cast("long")
        bits = F.shiftleft(half(1), 32).bitwiseOR(half(CODE_BITS // 8 + 1))
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        bits = _double_bits(c.cast("double") + F.lit(0.0))  # -0.0 is folded to 0.0
    else:
        if isinstance(kind, T.DateType):
            number = F.unix_date(c).cast("long")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            number = F.unix_micros(c.cast("timestamp"))
        else:
            number = c.cast("int").cast("long") if isinstance(kind, T.BooleanType) else c.cast("long")
        bits = number.bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(bits)


def _double_bits(x: Column) -> Column:
    """A long in the order of doubles, above 0: exponent and mantissa by arithmetic, as Spark has no bit cast."""
    size = F.abs(x)
    exponent = F.when(size > 0, F.greatest(F.floor(F.log2(size)), F.lit(-1022))).otherwise(F.lit(-1023)).cast("long")
    share = F.when(size > 0, size / F.pow(F.lit(2.0), exponent.cast("double"))).otherwise(F.lit(1.0))
    rank = (exponent + 1024) * F.lit(1 << 50) + (F.least(F.greatest(share - 1, F.lit(0.0)), F.lit(0.9999999)) * F.lit(float(1 << 50))).cast("long")
    rank = F.when(F.isnan(x) | (size == float("inf")), F.lit(1 << 61)).otherwise(rank)
    return F.when(x < 0, F.lit(1 << 62) - rank).otherwise(F.lit(1 << 62) + rank)


def zorder(codes: list[Column]) -> list[Column]:
    """Interleaved codes as a few longs to order by, most significant first; of one code, its halves.

    Every bit is placed by arithmetic that compiles into the scan's own loop. A word has
    63 bits at most, so its order needs no care for the sign.
    """
    if not codes:
        raise InvalidArgument("no column to order by")
    each = (CODE_BITS - 1) // len(codes)
    words = []
    for top in range(CODE_BITS - 1, -1, -each):
        word, places = F.lit(0).cast("long"), range(top, max(top - each, -1), -1)
        shift = len(places) * len(codes)
        for bit in places:
            for c in codes:
                shift -= 1
                word = word.bitwiseOR(F.shiftleft(F.shiftrightunsigned(c, bit).bitwiseAND(F.lit(1).cast("long")), shift))
        words.append(word)
    return words
