"""Column expressions: distances, labels, uniforms and 3x3 principal components."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell(value, size: float) -> Column:
    """Index of the grid cell of width ``size`` that holds ``value`` (origin 0)."""
    return F.floor(col(value) / F.lit(float(size))).cast("long")


def squared_distance(a, b) -> Column:
    """Sum of squared coordinate differences, added left to right."""
    total = None
    for p, q in zip(a, b):
        diff = col(p) - col(q)
        total = diff * diff if total is None else total + diff * diff
    return total


def literal_map(mapping: dict, default) -> callable:
    """Column -> column lookup in a fixed dictionary with a default."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    table = F.create_map(*pairs)
    return lambda c: F.coalesce(F.element_at(table, col(c)), F.lit(default))


def hash_uniform(seed: int, salt: str, *keys) -> Column:
    """Uniform in (0, 1) that depends only on the seed, the salt and the row keys: 52 bits of an MD5 over them.

    Unlike ``rand(seed)`` it does not change with the partitioning, and any engine can repeat it.
    """
    text = F.concat_ws("|", F.lit(str(int(seed))), F.lit(salt), *[col(k).cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def standard_normal(u1: Column, u2: Column) -> Column:
    """Box-Muller transform of two uniforms."""
    return F.sqrt(-2.0 * F.log(F.greatest(u1, F.lit(1e-300)))) * F.cos(F.lit(2.0 * math.pi) * u2)


def at_least(c: Column, floor: float) -> Column:
    return F.greatest(c, F.lit(float(floor)))


def safe_denominator(c: Column, eps: float = 1e-10) -> Column:
    return F.when(c < eps, F.lit(eps)).otherwise(c)


def with_eigenvalues(df, prefix: str = ""):
    """Add l1 >= l2 >= l3 of the symmetric 3x3 matrix in columns xx..yz (closed form).

    The steps are columns of their own: as one expression they would repeat each
    other and outgrow generated code.
    """
    c = lambda n: F.col(prefix + n)
    xx, yy, zz, xy, xz, yz = [c(n) for n in ("xx", "yy", "zz", "xy", "xz", "yz")]
    q, p, t = c("_q"), c("_p"), c("_t")
    df = df.withColumn(prefix + "_q", (xx + yy + zz) / 3.0)
    off = xy * xy + xz * xz + yz * yz
    spread = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2.0 * off
    df = df.withColumn(prefix + "_p", F.sqrt(spread / 6.0))
    a, b, d = xx - q, yy - q, zz - q
    det = a * (b * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - b * xz)
    r = F.when(p > 0, det / (p * p * p) / 2.0).otherwise(F.lit(0.0))
    df = df.withColumn(prefix + "_t", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3.0)
    df = df.withColumns({
        prefix + "l1": q + 2.0 * p * F.cos(t), prefix + "l3": q + 2.0 * p * F.cos(t + F.lit(2.0 * math.pi / 3.0)),
    })
    return df.withColumn(prefix + "l2", 3.0 * q - c("l1") - c("l3")).drop(*[prefix + n for n in ("_q", "_p", "_t")])


def normal_y(xx, zz, xz, l1, l2, l3):
    """|y component| of the eigenvector of the smallest eigenvalue.

    When the two smallest eigenvalues coincide the direction is undefined; 0 is
    returned (documented choice).
    """
    minor = (xx - l3) * (zz - l3) - xz * xz
    squared = minor / ((l3 - l1) * (l3 - l2))
    unit = F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), squared)))
    return F.when(l2 - l3 < 1e-12, F.lit(0.0)).otherwise(unit)


def principal_axes(df):
    """Add the columns ``l1..l3`` and unit axes ``a1x..a3z`` for covariance columns.

    Each axis is the longest cross product of two rows of ``A - l I``; the
    second axis is completed from the other two, so the frame is orthogonal.
    Degenerate directions fall back to the coordinate axes.
    """
    xx, yy, zz, xy, xz, yz = [F.col(n) for n in ("xx", "yy", "zz", "xy", "xz", "yz")]
    df = with_eigenvalues(df)

    def row_cross(lam, i, j):
        rows = [
            (xx - lam, xy, xz),
            (xy, yy - lam, yz),
            (xz, yz, zz - lam),
        ]
        (a, b, c), (d, e, f) = rows[i], rows[j]
        v = (b * f - c * e, c * d - a * f, a * e - b * d)
        return F.struct(
            (v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("n"),
            v[0].alias("x"), v[1].alias("y"), v[2].alias("z"),
        )

    def longest(lam):
        return F.greatest(row_cross(lam, 0, 1), row_cross(lam, 0, 2), row_cross(lam, 1, 2))

    df = df.withColumns({"_v1": longest(F.col("l1")), "_v3": longest(F.col("l3"))})
    tiny = F.greatest(F.col("l1"), F.lit(1e-12)) ** 4 * 1e-24
    ok = (F.col("_v1.n") > tiny) & (F.col("_v3.n") > tiny)
    out = {}
    for k, fallback in (("1", (1.0, 0.0, 0.0)), ("3", (0.0, 0.0, 1.0))):
        for axis, value in zip(XYZ, fallback):
            out[f"a{k}{axis}"] = F.when(ok, F.col(f"_v{k}.{axis}") / F.sqrt(F.col(f"_v{k}.n"))).otherwise(F.lit(value))
    df = df.withColumns(out)
    return df.withColumns({
        "a2x": F.col("a3y") * F.col("a1z") - F.col("a3z") * F.col("a1y"),
        "a2y": F.col("a3z") * F.col("a1x") - F.col("a3x") * F.col("a1z"),
        "a2z": F.col("a3x") * F.col("a1y") - F.col("a3y") * F.col("a1x"),
    }).drop("_v1", "_v3")


def covariance_sums(x: Column, y: Column, z: Column, when=None, prefix: str = ""):
    """Aggregates from which :func:`covariance` is computed (plain sums, so they
    combine map-side)."""
    def s(c):
        return F.sum(c if when is None else F.when(when, c))

    one = F.lit(1)
    return [
        (F.count(one if when is None else F.when(when, one))).alias(f"{prefix}n"),
        s(x).alias(f"{prefix}sx"), s(y).alias(f"{prefix}sy"), s(z).alias(f"{prefix}sz"),
        s(x * x).alias(f"{prefix}sxx"), s(y * y).alias(f"{prefix}syy"), s(z * z).alias(f"{prefix}szz"),
        s(x * y).alias(f"{prefix}sxy"), s(x * z).alias(f"{prefix}sxz"), s(y * z).alias(f"{prefix}syz"),
    ]


def covariance(prefix: str = "", ddof: int = 0) -> dict:
    """Columns xx..yz from the sums of :func:`covariance_sums`."""
    n = F.col(f"{prefix}n").cast("double")
    d = F.greatest(n - ddof, F.lit(1.0)) if ddof else n
    out = {}
    for pair in ("xx", "yy", "zz", "xy", "xz", "yz"):
        a, b = pair
        raw = F.col(f"{prefix}s{pair}") - F.col(f"{prefix}s{a}") * F.col(f"{prefix}s{b}") / n
        out[f"{prefix}{pair}"] = raw / d
    return out
