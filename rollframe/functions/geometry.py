"""Column expressions on plane positions and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the eight 45-degree bins, from straight ahead clockwise.
COMPASS = ["north", "north east", "east", "south east", "south", "south west", "west", "north west"]
CLOCK = ["around 12 o'clock", "around 1:30", "around 3 o'clock", "around 4:30",
         "around 6 o'clock", "around 7:30", "around 9 o'clock", "around 10:30"]
# Upper ends (exclusive) and names of the egocentric front bins.
FRONT_BINS = [(-45.001, "beyond-fov"), (-22.501, "front-left"), (-0.001, "front-slight-left"), (0.001, "front"),
              (22.501, "front-slight-right"), (45.001, "front-right")]
# Upper ends (exclusive) and names of the distance bins.
DISTANCE_BINS = [(1e-6, "same distance"), (2.000001, "near"), (4.000001, "mid distance"), (8.000001, "slightly far"),
                 (16.000001, "far"), (32.000001, "very far")]
FARTHEST = "extremely far"
# Fixed value: objects at most this far apart are in proximity.
PROXIMITY = 2.0
# Thresholds of the mean relative accuracy.
ACCURACY_LEVELS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]


def bearing(dx: Column, dy: Column, ox: Column | None = None, oy: Column | None = None) -> Column:
    """Degrees from the heading ``(ox, oy)`` (default north) to ``(dx, dy)``, clockwise positive."""
    if ox is None:
        turn = F.degrees(F.atan2(dx, dy))
    else:
        turn = -F.degrees(F.atan2(ox * dy - oy * dx, ox * dx + oy * dy))
    return F.when(F.greatest(F.abs(dx), F.abs(dy)) < 1e-6, 0.0).otherwise(turn)


def octant(degree: Column) -> Column:
    return F.pmod(F.floor((degree + 22.5) / 45.0), F.lit(8)).cast("int")


def octant_name(degree: Column, names: list[str] = COMPASS) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), octant(degree) + 1)


def front_bin(degree: Column) -> Column:
    out = F.when(degree <= -180.0, F.lit("beyond-fov"))
    for end, name in FRONT_BINS:
        out = out.when(degree < end, name)
    return out.otherwise("beyond-fov")


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx.cast("double") * dx + dy.cast("double") * dy)


def distance_bin(d: Column) -> Column:
    out = F.when(d <= -1e-6, F.raise_error(F.lit("invalid distance")).cast("string"))
    for end, name in DISTANCE_BINS:
        out = out.when(d < end, name)
    return out.otherwise(FARTHEST)


def _heading(x: Column, y: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(x.cast("double"), y.cast("double"))), F.lit(360.0))


def relative_orientation(ox: Column, oy: Column, ax: Column, ay: Column) -> Column:
    """Heading of one object seen from another, snapped to forward, right, backward or left."""
    diff = F.pmod(_heading(ox, oy) - _heading(ax, ay), F.lit(360.0))
    snapped = F.pmod(F.bround(diff / 90.0) * 90, F.lit(360)).cast("int")
    return F.when(snapped == 0, "forward").when(snapped == 90, "right").when(snapped == 180, "backward").otherwise("left")


def relation_holds(dx: Column, dy: Column, ox: Column, oy: Column, direction: Column | None = None,
                   distance_name: Column | None = None, degree: Column | None = None,
                   exact_distance: Column | None = None, nearby: bool = False) -> Column:
    """Does a stated relation (bins, exact bearing, exact distance or proximity) hold for a pair?"""
    deg, d = bearing(dx, dy, ox, oy), distance(dx, dy)
    ok = F.lit(True)
    if nearby:
        ok = ok & (d * d <= PROXIMITY * PROXIMITY + 1e-6)
    if distance_name is not None:
        ok = ok & (distance_bin(d) == distance_name)
    if direction is not None:
        ok = ok & (octant_name(deg) == direction)
    if degree is not None:
        ok = ok & (F.abs(deg - degree) <= 1e-6)
    if exact_distance is not None:
        ok = ok & (F.abs(d - exact_distance) <= 1e-6)
    return ok


def to_frame(x: Column, y: Column, ax: Column, ay: Column, ox: Column, oy: Column) -> tuple[Column, Column]:
    """World position seen from an anchor with one of the four headings (others count as north)."""
    dx, dy = (x - ax).cast("double"), (y - ay).cast("double")
    east, south, west = (ox == 1) & (oy == 0), (ox == 0) & (oy == -1), (ox == -1) & (oy == 0)
    return (F.when(east, -dy).when(south, -dx).when(west, dy).otherwise(dx),
            F.when(east, dx).when(south, -dy).when(west, -dx).otherwise(dy))


def from_frame(x: Column, y: Column, ax: Column, ay: Column, ox: Column, oy: Column) -> tuple[Column, Column]:
    """The inverse of :func:`to_frame`."""
    east, south, west = (ox == 1) & (oy == 0), (ox == 0) & (oy == -1), (ox == -1) & (oy == 0)
    x, y = x.cast("double"), y.cast("double")
    return (F.when(east, y).when(south, -x).when(west, -y).otherwise(x) + ax,
            F.when(east, -x).when(south, -y).when(west, x).otherwise(y) + ay)


def coordinate_similarity(px: Column, py: Column, gx: Column, gy: Column) -> Column:
    error, size = distance(px - gx, py - gy), distance(gx, gy)
    return F.when(size == 0, F.when(error == 0, 1.0).otherwise(0.0)).otherwise(F.exp(-error / size))


def relative_accuracy(similarity: Column) -> Column:
    """Share of the accuracy levels reached."""
    passed = F.lit(0)
    for level in ACCURACY_LEVELS:
        passed = passed + F.when(similarity >= level, 1).otherwise(0)
    return passed / float(len(ACCURACY_LEVELS))


def away_heading(dx: Column, dz: Column) -> Column:
    """The cardinal heading that faces away from a target at ``(dx, dz)``; ties go to the smaller one."""
    away = F.pmod(F.degrees(F.atan2(dx.cast("double"), dz.cast("double"))) + 180.0, F.lit(360.0))
    gap = lambda c: F.least(F.abs(away - c), 360.0 - F.abs(away - c))
    best = F.least(*[gap(float(c)) for c in (0, 90, 180, 270)])
    return F.when(gap(0.0) == best, 0.0).when(gap(90.0) == best, 90.0).when(gap(180.0) == best, 180.0).otherwise(270.0)
