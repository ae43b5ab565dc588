"""Statistics as column expressions: intervals, detectable differences and a counter-based random generator.

The generator is the 32-bit mulberry of the seeded resampler: its state after ``k`` calls is ``seed + k * step`` modulo
2^32, so draw ``k`` is a pure function of seed and ``k``. Resamples need no sequential state: every draw is one row of
``range`` and any partitioning gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054
_MASK = 0xFFFFFFFF
_STEP = 0x6D2B79F5


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def wilson(hits: Column | str, trials: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of the score interval of a proportion; the whole of [0, 1] without trials."""
    n, h = F.nullif(_c(trials).cast("double"), F.lit(0.0)), _c(hits).cast("double")
    p, z2 = h / n, z * z
    centre, d = p + z2 / (2 * n), 1 + z2 / n
    spread = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    some = _c(trials) > 0
    return F.when(some, clamp01((centre - spread) / d)).otherwise(0.0), F.when(some, clamp01((centre + spread) / d)).otherwise(1.0)


def rate(hits: Column | str, trials: Column | str) -> Column:
    return F.when(_c(trials) > 0, _c(hits) / F.nullif(_c(trials), F.lit(0))).otherwise(0.0)


def detectable_difference(prompts: Column | str, runs: Column | str) -> Column:
    """The smallest change that a paired measurement of that size can tell; 1 without data."""
    m, n = _c(prompts).cast("double"), _c(runs).cast("double")
    ok = (m > 0) & (n > 0)
    value = Z95 * (F.sqrt(0.25 / F.when(ok, n)) / F.sqrt(F.when(ok, m))) * (2.0**0.5)
    return F.when(ok, clamp01(value)).otherwise(1.0)


def _imul(a: Column, b: Column) -> Column:
    """Product modulo 2^32 of two 32-bit numbers held in bigints, without overflow."""
    low = a * b.bitwiseAND(F.lit(0xFFFF))
    high = (a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(_MASK))


def draw(seed: Column | int, k: Column) -> Column:
    """The ``k``-th (from 1) number in [0, 1) of the generator."""
    s = (_c(seed).cast("bigint") + k.cast("bigint") * F.lit(_STEP)).bitwiseAND(F.lit(_MASK))
    t = _imul(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    u = (t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_MASK))
    t = t.bitwiseXOR(u)
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)




def with_draw(df: DataFrame, seed: int, k: Column, name: str) -> DataFrame:
    """``df`` with draw ``k`` as column ``name``, in steps that Spark computes once each instead of one deep expression."""
    m = F.lit(_MASK)
    d = df.withColumn("_s", (F.lit(seed).cast("bigint") + k.cast("bigint") * F.lit(_STEP)).bitwiseAND(m))
    d = d.withColumn("_t", _imul(F.col("_s").bitwiseXOR(F.shiftright("_s", 15)), F.col("_s").bitwiseOR(F.lit(1))))
    d = d.withColumn("_u", F.col("_t").bitwiseXOR((F.col("_t") + _imul(F.col("_t").bitwiseXOR(F.shiftright("_t", 7)), F.col("_t").bitwiseOR(F.lit(61)))).bitwiseAND(m)))
    return d.withColumn(name, F.col("_u").bitwiseXOR(F.shiftright("_u", 14)) / F.lit(4294967296.0)).drop("_s", "_t", "_u")


def draw_sql(seed: str, k: str) -> str:
    """The same draw in DuckDB SQL, for oracles."""
    m = "4294967295"

    def imul(a: str, b: str) -> str:
        return f"((({a})*(({b}) & 65535) + (((({a})*(({b})>>16)) & 65535) << 16)) & {m})"

    s = f"((({seed})::BIGINT + ({k})::BIGINT * {_STEP}) & {m})"
    return f"""(SELECT (xor(t2, t2 >> 14)) / 4294967296.0::DOUBLE FROM (SELECT xor(t, (t + {imul('xor(t, t >> 7)', '(t | 61)')}) & {m}) AS t2
      FROM (SELECT {imul('xor(s, s >> 15)', '(s | 1)')} AS t FROM (SELECT {s} AS s))))"""


def seed_for(a: Column, b: Column) -> Column:
    """The 32-bit FNV-1a hash of ``a|b`` over its characters: the seed of the comparison of two runs."""
    text = F.concat(a, F.lit("|"), b)
    codes = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: _imul(h.bitwiseXOR(c), F.lit(16777619).cast("bigint")))
