"""Rectangles, intervals and quarter turns as column expressions. Coordinates are points, y down, on a grid of 0.01."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def quantize(c: Column) -> Column:
    """Rounded to 0.01, without a negative zero; null for what is not finite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(F.round(c, 2) + F.lit(0.0))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def contains_point(b: Box, x: Column, y: Column) -> Column:
    """Half-open both ways."""
    return (b[0] <= x) & (x < b[2]) & (b[1] <= y) & (y < b[3])


def contains_point_closed_if_flat(b: Box, x: Column, y: Column) -> Column:
    """Half-open, but an axis without extent is closed."""
    across = F.when(b[0] == b[2], x == b[0]).otherwise((b[0] <= x) & (x < b[2]))
    down = F.when(b[1] == b[3], y == b[1]).otherwise((b[1] <= y) & (y < b[3]))
    return across & down


def contains_rect(a: Box, b: Box) -> Column:
    """Closed."""
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (b[2] <= a[2]) & (b[3] <= a[3])


def intersects(a: Box, b: Box) -> Column:
    """In a positive area."""
    return (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & (F.least(a[3], b[3]) > F.greatest(a[1], b[1]))


def intervals_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) > F.greatest(a0, b0)


def union_all(b: Box) -> tuple[Column, Column, Column, Column]:
    """Aggregates: the bounding box."""
    return F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3])


def turn_point(rotation: Column, x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """From the unrotated page to the shown one; width and height of the unrotated page."""
    return (
        F.when(rotation == 90, height - y).when(rotation == 180, width - x).when(rotation == 270, y).otherwise(x),
        F.when(rotation == 90, x).when(rotation == 180, height - y).when(rotation == 270, width - x).otherwise(y),
    )


def turn_rect(rotation: Column, b: Box, width: Column, height: Column) -> Box:
    ax, ay = turn_point(rotation, b[0], b[1], width, height)
    cx, cy = turn_point(rotation, b[2], b[3], width, height)
    return F.least(ax, cx), F.least(ay, cy), F.greatest(ax, cx), F.greatest(ay, cy)


def unturn_rect(rotation: Column, b: Box, width: Column, height: Column) -> Box:
    """The inverse; width and height of the unrotated page still."""
    back = F.pmod(F.lit(360) - rotation, F.lit(360))
    swap = rotation.isin(90, 270)
    return turn_rect(back, b, F.when(swap, height).otherwise(width), F.when(swap, width).otherwise(height))


def in_polygon(points: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; points: array of structs with x and y."""
    n = F.size(points)
    edges = F.zip_with(points, F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossed = F.filter(edges, lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < (e.b.x - e.a.x) * (y - e.a.y) / F.when(e.b.y == e.a.y, F.lit(1.0)).otherwise(e.b.y - e.a.y) + e.a.x))
    return F.size(crossed) % 2 == 1


def diagonal(dx: Column, dy: Column) -> Column:
    """A direction between 15 and 75 degrees off an axis."""
    turn = F.degrees(F.atan2(F.abs(dy), F.abs(dx)))
    return (turn >= 15) & (turn <= 75)


def horizontal(dx: Column, dy: Column, tolerance: float = 1e-3) -> Column:
    return (F.abs(dx - 1) <= tolerance) & (F.abs(dy) <= tolerance)


def rule_length(start: Column, end: Column) -> Column:
    return end - start


def rule_rect(axis: Column, at: Column, start: Column, end: Column, thickness: Column) -> tuple[Column, Column, Column, Column]:
    """A rule's box, as thick as it is drawn."""
    half, across = thickness / 2, axis == "h"
    pick = lambda a, b: F.when(across, a).otherwise(b)
    return pick(start, at - half), pick(at - half, start), pick(end, at + half), pick(at + half, end)


def shown_size(rotation: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Width and height of a page as it displays."""
    turned = rotation.isin(90, 270)
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def from_shown(rotation: Column, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return (
        F.when(rotation == 90, y).when(rotation == 180, w - x).when(rotation == 270, w - y).otherwise(x),
        F.when(rotation == 90, h - x).when(rotation == 180, h - y).when(rotation == 270, x).otherwise(y),
    )


def to_user(x: Column, y: Column, left: Column, top: Column) -> tuple[Column, Column]:
    """A point from the top left corner in the page's own space, y up. left, top: the page box's."""
    return x + left, top - y


def to_icdar(rotation: Column, x: Column, y: Column, left: Column, top: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """A point in the frame of a table competition's truth: the page's own space, or a turned page as it displays, y up; null where a turned page's box is off the origin."""
    sx, sy = turn_point(rotation, x, y, w, h)
    _, high = shown_size(rotation, w, h)
    ux, uy = to_user(x, y, left, top)
    fits = (left == 0) & (top - h == 0)
    return F.when(rotation == 0, ux).when(fits, sx), F.when(rotation == 0, uy).when(fits, high - sy)


def from_icdar(rotation: Column, x: Column, y: Column, left: Column, top: Column, w: Column, h: Column) -> tuple[Column, Column]:
    _, high = shown_size(rotation, w, h)
    sx, sy = from_shown(rotation, x, high - y, w, h)
    fits = (left == 0) & (top - h == 0)
    return F.when(rotation == 0, x - left).when(fits, sx), F.when(rotation == 0, top - y).when(fits, sy)


def page_box(crop: tuple[Column, ...], media: tuple[Column, ...]) -> tuple[Column, ...]:
    """The crop box (x0, y0, x1, y1, down from the media box's top) within the media box, in its coordinates; nulls where they don't meet."""
    x0, x1 = F.greatest(crop[0], media[0]), F.least(crop[2], media[2])
    y0, y1 = F.greatest(media[3] - crop[3], media[1]), F.least(media[3] - crop[1], media[3])
    meets = (x1 > x0) & (y1 > y0)
    return tuple(F.when(meets, v) for v in (x0, y0, x1, y1))


def quarter(rotation: Column) -> Column:
    """A page's rotation as a quarter turn; others go to the nearest, halves to the even one."""
    return (F.bround(F.pmod(rotation, F.lit(360)) / 90, 0).cast("int") % 4) * 90
