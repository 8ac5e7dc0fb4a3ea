"""Spherical geometry as column expressions.

Frame: +X right, +Y up, +Z forward; pixel centres; longitude in [-pi, pi), latitude falls with the row.  A ray is a
struct (x, y, z).  Rows may be numbered through a stack of panoramas; ``row_in`` is the row in its own.  Nothing here
leaves whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

PI = math.pi


def ray(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def ray_of(lon: Column, lat: Column) -> Column:
    return ray(F.sin(lon) * F.cos(lat), F.sin(lat), F.cos(lon) * F.cos(lat))


def row_in(y: Column, height: int) -> Column:
    """The row in its panorama, of a row of a stack."""
    return F.pmod(y, F.lit(height))


def erp_pixel_to_ray(x: Column, y: Column, height: int, width: int) -> Column:
    return ray_of(2 * PI * (x + 0.5) / width - PI, PI / 2 - PI * (row_in(y, height) + 0.5) / height)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    return ray(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, ray(a["x"] / n, a["y"] / n, a["z"] / n))


def angle(a: Column, b: Column) -> Column:
    """Stable near 0 and pi."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def longitude(a: Column) -> Column:
    return F.atan2(a["x"], a["z"])


def latitude(a: Column) -> Column:
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(a["y"], norm(a)))))


def ray_to_erp_pixel(a: Column, height: int, width: int) -> Column:
    """(x, y, valid); x wraps into [0, width), a zero ray is not valid."""
    x = F.pmod((longitude(a) + PI) / (2 * PI) * width - 0.5, F.lit(float(width)))
    return F.struct(x.alias("x"), ((PI / 2 - latitude(a)) / PI * height - 0.5).alias("y"), (norm(a) > 0).alias("valid"))


def nearest(c: Column) -> Column:
    return F.floor(c + 0.5)


def row_area(y: Column, height: int, width: int) -> Column:
    """Exact solid angle of a cell of the row."""
    y = row_in(y, height)
    return (F.sin(PI / 2 - PI * y / height) - F.sin(PI / 2 - PI * (y + 1) / height)) * (2 * PI / width)


def rotate(matrix: list[list[float]], a: Column) -> Column:
    return ray(*[matrix[k][0] * a["x"] + matrix[k][1] * a["y"] + matrix[k][2] * a["z"] for k in range(3)])


def axis_rotation(axis: tuple[float, float, float], radians: float) -> list[list[float]]:
    """Rodrigues' formula."""
    n = math.sqrt(sum(a * a for a in axis)) or 1.0
    x, y, z = (a / n for a in axis)
    c, s = math.cos(radians), math.sin(radians)
    t = 1 - c
    return [[c + x * x * t, x * y * t - z * s, x * z * t + y * s], [y * x * t + z * s, c + y * y * t, y * z * t - x * s], [z * x * t - y * s, z * y * t + x * s, c + z * z * t]]


def view_basis(lat_deg: float, lon_deg: float, roll_deg: float = 0.0) -> tuple[tuple[float, float, float], ...]:
    """Right, up and forward of a view in world coordinates."""
    lat, lon, roll = (math.radians(v) for v in (lat_deg, lon_deg, roll_deg))
    forward = (math.sin(lon) * math.cos(lat), math.sin(lat), math.cos(lon) * math.cos(lat))
    right = (math.cos(lon), 0.0, -math.sin(lon))
    up = (-math.sin(lon) * math.sin(lat), math.cos(lat), -math.cos(lon) * math.sin(lat))
    c, s = math.cos(roll), math.sin(roll)
    return tuple(c * r + s * u for r, u in zip(right, up, strict=True)), tuple(c * u - s * r for r, u in zip(right, up, strict=True)), forward


def gnomonic_pixel(a: Column, basis: tuple, hfov_deg: float, vfov_deg: float, height: int, width: int) -> Column:
    """(u, v, valid) of a ray in a perspective view; valid in front and inside the closed footprint."""
    right, up, forward = (sum((F.lit(v) * a[k] for v, k in zip(axis, "xyz", strict=True)), F.lit(0.0)) for axis in basis)
    fx, fy = width / (2 * math.tan(math.radians(hfov_deg) / 2)), height / (2 * math.tan(math.radians(vfov_deg) / 2))
    ahead = forward > 0
    u = F.when(ahead, fx * right / forward + (width - 1) / 2)
    v = F.when(ahead, (height - 1) / 2 - fy * up / forward)
    inside = ahead & u.between(-0.5, width - 0.5) & v.between(-0.5, height - 0.5)
    return F.struct(u.alias("u"), v.alias("v"), F.coalesce(inside, F.lit(False)).alias("valid"))


def gnomonic_ray(u: Column, v: Column, basis: tuple, hfov_deg: float, vfov_deg: float, height: int, width: int) -> Column:
    fx, fy = width / (2 * math.tan(math.radians(hfov_deg) / 2)), height / (2 * math.tan(math.radians(vfov_deg) / 2))
    a, b = (u - (width - 1) / 2) / fx, ((height - 1) / 2 - v) / fy
    right, up, forward = basis
    return unit(ray(*[a * right[k] + b * up[k] + forward[k] for k in range(3)]))


def tangent_offset_ray(a: Column, east: Column, north: Column) -> Column:
    """Exponential map of an east and a north offset at a unit ray."""
    lon, lat = longitude(a), latitude(a)
    e = ray(F.cos(lon), F.lit(0.0), -F.sin(lon))
    n = ray(-F.sin(lon) * F.sin(lat), F.cos(lat), -F.cos(lon) * F.sin(lat))
    r = F.sqrt(east * east + north * north)
    s = F.when(r > 0, F.sin(r) / r).otherwise(1.0)
    return ray(*[F.cos(r) * a[k] + s * (east * e[k] + north * n[k]) for k in "xyz"])


def pinhole_ray(u: Column, v: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    return unit(ray((u - cx) / fx, (v - cy) / fy, F.lit(1.0)))


def pinhole_pixel(a: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    ahead = a["z"] > 0
    return F.struct(F.when(ahead, fx * a["x"] / a["z"] + cx).alias("u"), F.when(ahead, fy * a["y"] / a["z"] + cy).alias("v"), ahead.alias("valid"))


def fisheye_pixel(a: Column, focal: float, cx: float, cy: float, k: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)) -> Column:
    """Equidistant fisheye with an odd polynomial in the angle."""
    side = F.sqrt(a["x"] * a["x"] + a["y"] * a["y"])
    t = F.atan2(side, a["z"])
    bent = t * (1 + sum((k[j] * F.pow(t, F.lit(2.0 * (j + 1))) for j in range(4)), F.lit(0.0)))
    s = F.when(side > 0, focal * bent / side).otherwise(0.0)
    return F.struct((s * a["x"] + cx).alias("u"), (s * a["y"] + cy).alias("v"))


def epipolar_residual(a: Column, b: Column, essential: list[list[float]]) -> Column:
    """Sampson error of two bearings on the sphere's tangent planes."""
    ea = rotate(essential, a)
    eb = rotate([list(r) for r in zip(*essential, strict=True)], b)
    value = dot(b, ea)
    gradient = dot(ea, ea) - value * value + dot(eb, eb) - value * value
    return F.when(gradient > 0, F.abs(value) / F.sqrt(gradient)).otherwise(F.abs(value))


def luma(r: Column, g: Column, b: Column) -> Column:
    """ITU-R 601."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def fisheye_ray(u: Column, v: Column, focal: float, cx: float, cy: float, k: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0), steps: int = 8) -> Column:
    """Inverse of ``fisheye_pixel`` by Newton steps on the angle; exact where the polynomial rises."""
    dx, dy = u - cx, v - cy
    bent = F.sqrt(dx * dx + dy * dy) / focal

    def step(t: Column) -> Column:
        value = t * (1 + sum((k[j] * F.pow(t, F.lit(2.0 * (j + 1))) for j in range(4)), F.lit(0.0)))
        slope = 1 + sum((k[j] * (2 * j + 3) * F.pow(t, F.lit(2.0 * (j + 1))) for j in range(4)), F.lit(0.0))
        return t - (value - bent) / slope

    t = F.aggregate(F.array_repeat(F.lit(0), steps), bent, lambda seen, _: step(seen))
    s = F.when(bent > 0, F.sin(t) / (bent * focal)).otherwise(0.0)
    return ray(s * dx, s * dy, F.cos(t))


def world_point_to_camera_ray(point: Column, centre: tuple[float, float, float], matrix: list[list[float]]) -> Column:
    """Unit bearing of a world point; ``matrix`` turns camera into world directions."""
    moved = ray(*[point[k] - c for k, c in zip("xyz", centre, strict=True)])
    return unit(rotate([list(r) for r in zip(*matrix, strict=True)], moved))


def rotation_exp(x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rodrigues' formula for a rotation vector in columns."""
    t = F.sqrt(x * x + y * y + z * z)
    s, c = F.when(t > 0, F.sin(t) / t).otherwise(1.0), F.when(t > 0, (1 - F.cos(t)) / (t * t)).otherwise(0.5)
    return [[1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y], [c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x], [c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y)]]


def rotation_log(m: list[list[Column]]) -> Column:
    """Rotation vector of a matrix in columns, for angles below pi."""
    skew = ray((m[2][1] - m[1][2]) / 2, (m[0][2] - m[2][0]) / 2, (m[1][0] - m[0][1]) / 2)
    s = norm(skew)
    t = F.atan2(s, (m[0][0] + m[1][1] + m[2][2] - 1) / 2)
    f = F.when(s > 0, t / s).otherwise(1.0)
    return ray(*[f * skew[k] for k in "xyz"])


def relative_rotation(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    """b a': what turns the directions of pose a into those of pose b."""
    return [[sum((b[i][k] * a[j][k] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]


def tangent_log(a: Column, b: Column) -> Column:
    """(east, north) of a unit ray b in the tangent plane at a: the inverse of ``tangent_offset_ray``."""
    lon, lat = longitude(a), latitude(a)
    e = ray(F.cos(lon), F.lit(0.0), -F.sin(lon))
    n = ray(-F.sin(lon) * F.sin(lat), F.cos(lat), -F.cos(lon) * F.sin(lat))
    east, north = dot(b, e), dot(b, n)
    side = F.sqrt(east * east + north * north)
    f = F.when(side > 0, F.atan2(side, dot(a, b)) / side).otherwise(1.0)
    return F.struct((f * east).alias("east"), (f * north).alias("north"))
