"""The audit byte grammar, ids and severity as Column expressions.

All of it stays inside whole-stage codegen: a digest for every alert is a projection,
not a per-row Python call.

Rendering rules (per field): null -> NUL, bool -> 1/0, integer -> base 10,
float -> fixed 8 decimals of the
exact binary value (ties to even), string -> raw, list -> elements rendered recursively and
joined by RS.  A record is its rendered fields joined by US, hashed as UTF-8.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    ByteType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    NullType,
    ShortType,
    StringType,
)

from surveil.schemas import NUL, RS, US

_INTEGRAL = (ByteType, ShortType, IntegerType, LongType)


_TEN8 = 10 ** 8


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _dec(c: Column, digits: int = 38) -> Column:
    return c.cast(f"decimal({digits},0)")


def _big(n: int) -> Column:
    return F.lit(Decimal(n))


def _cut30(rest: Column, then) -> Column:
    """Top 30 bits of a fraction in [0, 1) and what is left of it."""
    return _let(rest * F.lit(2.0 ** 30), lambda s: _let(F.floor(s), lambda p: then(p, s - p.cast("double"))))


def fixed8(x: Column) -> Column:
    """``%.8f`` of a double: its exact binary value rounded half-even to 8 decimals, sign of zero kept.

    Whole part and fraction of |x| are exact doubles; the fraction is cut into three 30-bit
    integers, so fraction * 10**8 / 2**90 is decided in integer decimals. Bits below 2**-90 only
    matter for breaking a tie and are kept as a flag. From 2**106 on (33 digits) the shortest
    decimal form is used."""
    def rounded(total: Column, rest: Column, whole: Column) -> Column:
        def pick(q: Column) -> Column:
            # the quotient of decimals may be off by one: settle it, then compare the remainder
            q = q + F.when(_dec(q * _big(2 ** 90)) > total, -1).when(_dec((q + 1) * _big(2 ** 90)) <= total, 1).otherwise(0)
            return _let(q.cast("long"), lambda k: _let(_dec(total - _dec(_dec(k, 10) * _big(2 ** 90))), lambda left: _let(
                k + F.when((left > _big(2 ** 89)) | ((left == _big(2 ** 89)) & ((rest > 0) | (F.pmod(k, F.lit(2)) == 1))), 1).otherwise(0),
                lambda n: F.concat(_dec(whole + F.when(n == _TEN8, 1).otherwise(0)).cast("string"), F.lit("."),
                                   F.lpad(F.pmod(n, F.lit(_TEN8)).cast("string"), 8, "0")))))
        return _let(F.floor(total / _big(2 ** 90)), pick)

    def fraction(frac: Column, whole: Column) -> Column:
        return _cut30(frac, lambda a, r1: _cut30(r1, lambda b, r2: _cut30(r2, lambda c, r3: _let(
            _dec(_dec(_dec(_dec(a, 10) * _big(2 ** 60 * _TEN8)) + _dec(_dec(b, 10) * _big(2 ** 30 * _TEN8))) + _dec(_dec(c, 10) * _big(_TEN8))),
            lambda total: rounded(total, r3, whole)))))

    def digits(a: Column) -> Column:
        return _let(F.floor(a / F.lit(2.0 ** 53)), lambda hi: _let(a - hi.cast("double") * F.lit(2.0 ** 53), lambda low: _let(
            F.floor(low), lambda units: fraction(low - units.cast("double"), _dec(_dec(hi, 17) * _big(2 ** 53)) + _dec(units, 17)))))

    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    a = F.abs(x)
    return (F.when(F.isnan(x), F.lit("nan")).when(a == F.lit(float("inf")), F.concat(sign, F.lit("inf")))
            .when(a >= F.lit(2.0 ** 106), F.format_string("%.8f", x)).otherwise(F.concat(sign, digits(a))))


def canonical_field(c: Column, dtype: DataType) -> Column:
    """Render one column to its canonical string (never null)."""
    if isinstance(dtype, NullType):
        return F.lit(NUL)
    if isinstance(dtype, StringType):
        r = c
    elif isinstance(dtype, BooleanType):
        r = F.when(c, F.lit("1")).when(~c, F.lit("0"))
    elif isinstance(dtype, _INTEGRAL):
        r = c.cast("string")
    elif isinstance(dtype, (DoubleType, FloatType)):
        r = F.when(c.isNotNull(), fixed8(c.cast("double")))
    elif isinstance(dtype, ArrayType):
        r = F.array_join(F.transform(c, lambda x: canonical_field(x, dtype.elementType)), RS)
    else:
        raise TypeError(f"non-canonicalizable field type: {dtype.simpleString()}")
    return F.coalesce(r, F.lit(NUL))


def canonical_body(fields: Sequence[tuple[Column, DataType]]) -> Column:
    """Join rendered fields with US; the UTF-8 encoding happens inside ``sha2``."""
    return F.concat_ws(US, *[canonical_field(c, t) for c, t in fields])


def canonical_body_of(df: DataFrame, cols: Sequence[str]) -> Column:
    """``canonical_body`` over named columns, types taken from ``df``'s schema."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return canonical_body([(F.col(c), types[c]) for c in cols])


def digest(body: Column, algo: str = "sha256") -> Column:
    """Hex digest of a canonical body. Only SHA-256 runs inside Spark."""
    if algo != "sha256":
        raise ValueError(f"unsupported algo: {algo}")
    return F.sha2(body, 256)


def alert_id(detector: Column, trader: Column, instrument: Column,
             window_start: Column, window_end: Column) -> Column:
    """First 32 hex chars of the SHA-256 of the dedupe tuple, shaped 8-4-4-4-12."""
    h = digest(canonical_body([
        (detector, StringType()), (trader, StringType()), (instrument, StringType()),
        (window_start, LongType()), (window_end, LongType()),
    ]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def severity(rule_score: Column, floor: int = 1) -> Column:
    """min(5, max(floor, 1, ceil(5 * score))) as int."""
    raw = F.ceil(rule_score * F.lit(5.0))
    return F.least(F.lit(5), F.greatest(F.lit(floor), F.lit(1), raw)).cast("int")


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def chain_link(prev_hash: Column, body: Column) -> Column:
    """entry_hash = H(prev_hash_ascii + '|' + body)."""
    return F.sha2(F.concat(prev_hash, F.lit("|"), body), 256)
