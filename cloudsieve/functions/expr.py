"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def hash_int(*parts: str | Column | int) -> Column:
    """First 32 bits of the md5 of the '|'-joined parts, as a long."""
    key = F.concat_ws("|", *[F.lit(str(p)) if isinstance(p, int) else col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash01(*parts: str | Column | int) -> Column:
    """Uniform number in [0, 1) that depends only on the parts, never on partitioning."""
    return hash_int(*parts) / F.lit(4294967296.0)


def hash_normal(*parts: str | Column | int) -> Column:
    """Standard normal number from two hashed uniforms (Box-Muller)."""
    u = F.greatest(hash01(*parts, F.lit("u")), F.lit(1e-12))
    v = hash01(*parts, F.lit("v"))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def norm3(x, y, z) -> Column:
    return F.sqrt(dbl(x) * dbl(x) + dbl(y) * dbl(y) + dbl(z) * dbl(z))


def dot3(a: Sequence, b: Sequence) -> Column:
    return dbl(a[0]) * dbl(b[0]) + dbl(a[1]) * dbl(b[1]) + dbl(a[2]) * dbl(b[2])


def dist3(a: Sequence, b: Sequence) -> Column:
    d = [dbl(p) - dbl(q) for p, q in zip(a, b)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def is_finite_point(x, y, z) -> Column:
    out = None
    for c in (dbl(x), dbl(y), dbl(z)):
        ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
        out = ok if out is None else out & ok
    return out


def on_border(pix: str | Column, height: str | Column, width: str | Column, border: int = 10) -> Column:
    """Flat pixel index lies within ``border`` pixels of the image edge."""
    row = F.floor(col(pix) / col(width))
    column = F.pmod(col(pix), col(width))
    return (row < border) | (row >= col(height) - border) | (column < border) | (column >= col(width) - border)


def nearest_index(i: str | Column, size_out: str | Column, size_in: str | Column) -> Column:
    """Source index of output index ``i`` in a nearest-neighbour resize (pixel centres)."""
    return F.floor((dbl(i) + 0.5) * dbl(size_in) / dbl(size_out)).cast("long")


def apply_pose(points: Sequence, pose: str | Column) -> list[Column]:
    """Rigid transform of three columns by a row-major 16-element pose array."""
    t = col(pose)
    p = [dbl(c) for c in points]
    return [
        t[4 * r] * p[0] + t[4 * r + 1] * p[1] + t[4 * r + 2] * p[2] + t[4 * r + 3]
        for r in range(3)
    ]


def rotation_entries(axis: Sequence, angle: str | Column) -> list[Column]:
    """Nine row-major entries of the rotation about a unit axis by an angle in radians."""
    a = [dbl(c) for c in axis]
    s, v = F.sin(dbl(angle)), F.lit(1.0) - F.cos(dbl(angle))
    cross = [[None, -a[2], a[1]], [a[2], None, -a[0]], [-a[1], a[0], None]]
    out = []
    for r in range(3):
        for c in range(3):
            e = v * (a[r] * a[c] - (F.lit(1.0) if r == c else F.lit(0.0)))
            if r == c:
                e = e + F.lit(1.0)
            else:
                e = e + s * cross[r][c]
            out.append(e)
    return out


def pose_distance(a: str | Column, b: str | Column) -> Column:
    """Rotation angle in degrees between two poses plus 200 x the distance of their shifts."""
    p, q = col(a), col(b)
    trace = None
    for r in range(3):
        for c in range(3):
            term = p[4 * r + c] * q[4 * r + c]
            trace = term if trace is None else trace + term
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1.0) / 2.0))
    shift = F.sqrt(sum(((p[i] - q[i]) * (p[i] - q[i]) for i in (3, 7, 11)), F.lit(0.0)))
    return F.degrees(F.acos(cosine)) + F.lit(200.0) * shift


def vec_dist(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two numeric arrays, summed in double."""
    d = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def sample_id(path: str | Column) -> Column:
    """File name, prefixed by the defect folder where files sit in an ``xyz`` folder."""
    parts = F.split(col(path), "/")
    name = F.element_at(parts, -1)
    nested = (F.size(parts) >= 3) & (F.element_at(parts, -2) == "xyz")
    return F.when(nested, F.concat(F.element_at(parts, -3), F.lit("_"), name)).otherwise(name)


def file_stem(path: str | Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")


def defect_fraction(n_anom: str | Column, n_points: str | Column) -> Column:
    return dbl(n_anom) / F.greatest(dbl(n_points), F.lit(1.0))


def half_even_share(n: str | Column, share: float) -> Column:
    """max(1, round(share * n)) with ties to even."""
    return F.greatest(F.lit(1), F.bround(F.lit(share) * dbl(n)).cast("long"))
