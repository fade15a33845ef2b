"""Scalar geometry and colour expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import add, dot, scale, sqdist, subtract


def line_parameter(p: Column, a: Column, b: Column) -> Column:
    """Where p projects on the line through a (0) and b (1)."""
    d = subtract(b, a)
    return dot(subtract(p, a), d) / dot(d, d)


def project_to_line(p: Column, a: Column, b: Column) -> Column:
    """Squared distance of p to the line through a and b."""
    return sqdist(p, add(a, scale(subtract(b, a), line_parameter(p, a, b))))


def project_to_segment(p: Column, a: Column, b: Column) -> Column:
    """Squared distance of p to the segment from a to b."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), line_parameter(p, a, b)))
    return sqdist(p, add(a, scale(subtract(b, a), t)))


def in_circle(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) < radius * radius


def in_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Whether a ray to the right crosses the sides an odd number of times."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 != y2:
            hit = ((y < y1) != (y < y2)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def ray_sphere(origin: Column, direction: Column, center: Column, radius: Column) -> Column:
    """The ray's parameters where it meets the sphere, in order; empty without a hit."""
    o = subtract(origin, center)
    a, b, c = dot(direction, direction), 2 * dot(o, direction), dot(o, o) - radius * radius
    d = b * b - 4 * a * c
    root = F.sqrt(d)
    return F.when(d < 0, F.array().cast("array<double>")).when(d == 0, F.array(-b / (2 * a))).otherwise(F.array((-b - root) / (2 * a), (-b + root) / (2 * a)))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, saturation and value of colours in 0..1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    hue = F.when(d == 0, 0.0).when(high == r, 60 * ((g - b) / d)).when(high == g, 60 * ((b - r) / d + 2)).otherwise(60 * ((r - g) / d + 4))
    return F.array(F.when(hue < 0, hue + 360).otherwise(hue), F.when(high == 0, 0.0).otherwise(d / high), high)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    def channel(n: int) -> Column:
        k = (F.lit(float(n)) + h / 60) % 6
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.array(channel(5), channel(3), channel(1))


def circle_layout(rank: Column, n: int, radius: float = 1.0) -> Column:
    """A place on a circle for each of n ranks."""
    t = rank * (2 * math.pi / n)
    return F.array(F.cos(t) * radius, F.sin(t) * radius)
