"""Boxes seen from above: length runs along x, width along y, and yaw is left aside in overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(row: Column | None, name: str) -> Column:
    return F.col(name) if row is None else row[name]


def intersection(a: Column | None, b: Column | None, suffix: str = "") -> Column:
    """The area that two rows or structs with x, y, w, l share."""
    ax, ay, aw, al = (field(a, n) for n in "xywl")
    bx, by, bw, bl = (field(b, n + suffix) for n in "xywl")
    dx = F.least(ax + al / 2, bx + bl / 2) - F.greatest(ax - al / 2, bx - bl / 2)
    dy = F.least(ay + aw / 2, by + bw / 2) - F.greatest(ay - aw / 2, by - bw / 2)
    return F.greatest(F.lit(0.0), dx) * F.greatest(F.lit(0.0), dy)


def iou(a: Column | None, b: Column | None, suffix: str = "", inter: Column | None = None) -> Column:
    """Overlap of two rows or structs with x, y, w, l over their union; 0 if they do not overlap.  ``inter``: their
    intersection, where it is known, as lambdas evaluate each mention of it."""
    inter = intersection(a, b, suffix) if inter is None else inter
    union = field(a, "w") * field(a, "l") + field(b, "w" + suffix) * field(b, "l" + suffix) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def distance(a: Column | None, b: Column | None, suffix: str = "") -> Column:
    dx, dy = (field(a, n) - field(b, n + suffix) for n in "xy")
    return F.sqrt(dx * dx + dy * dy)


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def yaw(qw: Column, qx: Column, qy: Column, qz: Column) -> Column:
    return F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NaN stays NaN at the upper end, as it does not compare."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def transform_point(matrix: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point through a row-major homogeneous 4 x 4 matrix."""

    def row(k: int) -> Column:
        m = [F.get(F.get(matrix, F.lit(k)), F.lit(j)) for j in range(4)]
        return m[0] * x + m[1] * y + m[2] * z + m[3]

    return row(0), row(1), row(2)


def compose_yaw(local: Column, inner: Column, outer: Column) -> Column:
    """Yaw of a box turned by ``local``, then by the rotations of ``inner`` and ``outer``."""

    def at(m: Column, i: int, j: int) -> Column:
        return F.get(F.get(m, F.lit(i)), F.lit(j))

    first = [at(inner, k, 0) * F.cos(local) + at(inner, k, 1) * F.sin(local) for k in range(3)]
    x, y = (sum((at(outer, r, k) * first[k] for k in range(1, 3)), at(outer, r, 0) * first[0]) for r in (0, 1))
    return F.atan2(y, x)


def to_ego(x: Column, y: Column, z: Column, turn: Column, ego: tuple[Column, Column, Column, Column]) -> dict[str, Column]:
    """Position and yaw in the frame of an ego pose (x, y, z, yaw), with the yaw's quaternion."""
    ex, ey, ez, et = ego
    dx, dy, c, s = x - ex, y - ey, F.cos(et), F.sin(et)
    t = turn - et
    return {"x": c * dx + s * dy, "y": -s * dx + c * dy, "z": z - ez, "yaw": t, "qw": F.cos(t / 2), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(t / 2)}


def sensor_to_ego(x: Column, y: Column, z: Column, sensor: tuple[Column, Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A point of a sensor that stands at (x, y, z) with a yaw, in the ego frame."""
    sx, sy, sz, st = sensor
    return F.cos(st) * x - F.sin(st) * y + sx, F.sin(st) * x + F.cos(st) * y + sy, z + sz


def corners(x: Column, y: Column, w: Column, l: Column, turn: Column) -> Column:  # noqa: E741
    """The four corners, front left first, clockwise, and the middle of the front edge."""
    c, s = F.cos(turn), F.sin(turn)

    def at(u: float, v: float) -> Column:
        return F.struct((x + c * (u * l) - s * (v * w)).alias("x"), (y + s * (u * l) + c * (v * w)).alias("y"))

    return F.array(at(0.5, 0.5), at(0.5, -0.5), at(-0.5, -0.5), at(-0.5, 0.5), at(0.5, 0.0))


def height_shade(z: Column, low: float = -3.0, high: float = 5.0) -> Column:
    return clip((z - low) / (high - low))


def drivable_ladder(true_distance: Column, levels: tuple[float, ...] = (2.0, 8.0), cap: float = 16.0) -> Column:
    """0 on the area, then the least level not exceeded, else ``cap``; -1 where no map is known."""
    out = F.when(true_distance.isNull(), F.lit(-1.0)).when(true_distance <= 0, F.lit(0.0))
    for level in levels:
        out = out.when(true_distance <= level, F.lit(level))
    return out.otherwise(F.lit(cap))


def bin_label(x: Column, edges: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.01)) -> Column:
    """The number of the left-closed bin; null outside."""
    out = F.when(x < edges[0], None)
    for k, high in enumerate(edges[1:]):
        out = out.when(x < high, F.lit(k))
    return out
