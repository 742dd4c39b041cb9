"""Numbers as text, exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatecast.functions.text import bound

_BITS = 52  # of a double's fraction


def three_decimals(value: Column) -> Column:
    """A double's exact binary value with three decimals, ties to even; ``nan``, ``inf`` and ``-inf`` for the others.

    The built-in formats round the shortest decimal that reads as the number, halves up. Here the number is taken apart
    into a whole mantissa of 53 bits and a power of two, a thousand times which fits into a long; the bits below the
    point are compared with a half. From 2**53 on (to about 2**114) there are no such bits, and the number is written whole.
    """

    def written(x: Column) -> Column:
        size = F.abs(x)
        small, big = size < 2.0**-11, size >= 2.0**53
        usual = F.when(small | big | F.isnan(x), F.lit(1.0)).otherwise(size)
        return F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(
            F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), F.when(big, _whole(size)).when(small, "0.000").otherwise(bound(usual, _scaled)))
        )

    return bound(value.cast("double"), written)


def _exponent(size: Column) -> Column:
    guess = F.floor(F.log2(size)).cast("int")
    return guess + F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).when(size < F.pow(F.lit(2.0), guess), -1).otherwise(0)


def _shift(name: str, value: Column | int, by: Column) -> Column:
    return F.call_function(name, F.lit(value).cast("long") if isinstance(value, int) else value, by)


def _scaled(size: Column) -> Column:
    """Of a number from 2**-11 to below 2**53: its thousandths, by shifting its mantissa."""

    def nearest(scaled: Column, shift: Column) -> Column:
        def choice(low: Column) -> Column:
            rest, half = scaled - _shift("shiftleft", low, shift), _shift("shiftleft", 1, shift - 1)
            return low + ((shift > 0) & ((rest > half) | ((rest == half) & (low % 2 == 1)))).cast("long")

        return bound(_shift("shiftright", scaled, shift), choice)

    def thousandths(shift: Column) -> Column:
        return bound((size * F.pow(F.lit(2.0), shift)).cast("long") * 1000, lambda scaled: nearest(scaled, shift))

    return bound(
        bound(F.lit(_BITS) - _exponent(size), thousandths),
        lambda n: F.concat(F.call_function("div", n, F.lit(1000).cast("long")).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0")),
    )


def _whole(size: Column) -> Column:
    """Of a number from 2**53 on: its mantissa times a power of two, in decimal."""
    over = F.least(_exponent(size) - _BITS, F.lit(62))
    mantissa = (size / F.pow(F.lit(2.0), over)).cast("long").cast("decimal(19,0)")
    return F.concat((mantissa * _shift("shiftleft", 1, over).cast("decimal(19,0)")).cast("decimal(38,0)").cast("string"), F.lit(".000"))
