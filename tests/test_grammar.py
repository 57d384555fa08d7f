"""Byte grammar, digests, ids and severity against golden values."""
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, NullType, StringType

from surveil.functions import grammar as Gm

GOLDEN_BYTES = ("53504f4f46494e471f7472616465722d371f52591f313731383530303030303030301f313731383530303036303030301f341f"
                "302e38373530303030301f001f65311e65321e65331f554d49522d322e321f6571756974791f31373138353030303631303030")
GOLDEN_SHA = "10de2c38a21b0245e2ed067f8d92eefb58eeff5b318ad20848aab52956f2fde0"


def _one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0]["x"]


def test_golden_record_bytes_and_digest(spark):
    body = Gm.canonical_body([
        (F.lit("SPOOFING"), StringType()), (F.lit("trader-7"), StringType()), (F.lit("RY"), StringType()),
        (F.lit(1718500000000), LongType()), (F.lit(1718500060000), LongType()), (F.lit(4), IntegerType()),
        (F.lit(0.875), DoubleType()), (F.lit(None), NullType()),
        (F.array(F.lit("e1"), F.lit("e2"), F.lit("e3")), ArrayType(StringType())),
        (F.array(F.lit("UMIR-2.2")), ArrayType(StringType())), (F.lit("equity"), StringType()),
        (F.lit(1718500061000), LongType())])
    assert _one(spark, F.lower(F.hex(F.encode(body, "UTF-8")))) == GOLDEN_BYTES
    assert _one(spark, Gm.digest(body)) == GOLDEN_SHA


def test_float_rendering_ties_and_nulls(spark):
    assert _one(spark, Gm.canonical_field(F.lit(0.001953125), DoubleType())) == "0.00195312"
    assert _one(spark, Gm.canonical_field(F.lit(1.0), DoubleType())) == "1.00000000"
    assert _one(spark, Gm.canonical_field(F.lit(None).cast("double"), DoubleType())) == "\x00"
    assert _one(spark, Gm.canonical_field(F.lit(-3), LongType())) == "-3"
    assert _one(spark, Gm.canonical_field(F.lit(True), Gm.BooleanType())) == "1"
    assert _one(spark, Gm.canonical_field(F.array().cast("array<string>"), ArrayType(StringType()))) == ""
    assert _one(spark, Gm.canonical_field(F.lit(None).cast("array<string>"), ArrayType(StringType()))) == "\x00"


def test_float_rendering_equals_exact_binary_rounding(spark):
    import math
    import random
    r = random.Random(8)
    xs = [0.0, -0.0, 0.700000015, 1.5e-8, -1e-9, 5e-324, 2.0 ** 53 + 2, 1e22, 1e23, 0.999999995, math.inf, -math.inf, math.nan]
    xs += [k * 5e-9 for k in range(1, 400)] + [-k / 512 for k in range(300)] + [math.ldexp(r.random(), r.randint(-60, 60)) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [g.y for g in df.select(Gm.fixed8(F.col("x")).alias("y")).collect()] == [f"{x:.8f}" for x in xs]


def test_nested_lists_join_recursively(spark):
    arr = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))
    assert _one(spark, Gm.canonical_field(arr, ArrayType(ArrayType(IntegerType())))) == "1\x1e2\x1e3"


def test_unsupported_algo_and_type():
    import pytest
    with pytest.raises(ValueError):
        Gm.digest(None, "blake3")
    with pytest.raises(TypeError):
        Gm.canonical_field(None, Gm.DataType())


def test_severity_formula(spark):
    vals = [0.0, 0.0001, 0.2, 0.2000001, 0.71, 0.8, 1.0, 1.5]
    got = spark.createDataFrame([(v,) for v in vals], "s double").select(Gm.severity(F.col("s")).alias("v")).collect()
    assert [r["v"] for r in got] == [1, 1, 1, 2, 4, 4, 5, 5]


def test_two_entry_fold_from_genesis(spark):
    from surveil.schemas import GENESIS_HASH
    h1 = Gm.chain_link(F.lit(GENESIS_HASH), F.lit("x"))
    h2 = Gm.chain_link(h1, F.lit("y"))
    assert _one(spark, h2) == "443c0cdc92330bce8e52ac8d17b40271cc54da3980c6831db9d014df3059bd01"
