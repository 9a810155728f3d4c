"""Grid cells, yaw bins and height bins as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 3x3 grid, the compass ring in clockwise order, the height bins.
CELLS = ("A1", "A2", "A3", "B1", "B2", "B3", "C1", "C2", "C3")
YAW_BINS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
Z_BINS = ("HIGH", "MID", "LOW")
MODES = ("translation", "rotation", "gripper")
# Compass bins counter-clockwise from angle 0, and the height limits in metres.
YAW_BY_ANGLE = ("E", "NE", "N", "NW", "W", "SW", "S", "SE")
Z_HIGH_MIN = 0.35
Z_MID_MIN = 0.18


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _row(cell: Column) -> Column:
    """The code of the upper-case row letter; only letters beyond ASCII need Unicode's case rules."""
    code = F.ascii(cell)
    return F.when(code < 97, code).when(code <= 122, code - 32).when(code < 128, code).otherwise(F.ascii(F.upper(cell)))


def cell_distance(a: Column, b: Column) -> Column:
    """Grid steps between two cells (rows plus columns)."""
    rows = F.abs(_row(a) - _row(b))
    cols = F.abs(F.substring(a, 2, 1).cast("int") - F.substring(b, 2, 1).cast("int"))
    return rows + cols


def cell_label(index: Column) -> Column:
    """Row-major cell index 0..8 to its label; anything else is null."""
    return F.get(literal_array(CELLS), index.cast("int"))


def _near(cell: str) -> list[str]:
    up, down, left, right = (-1, 0), (1, 0), (0, -1), (0, 1)
    row, col = divmod(CELLS.index(cell), 3)
    near = [(row + dr, col + dc) for dr, dc in (up, down, left, right)]
    return [CELLS[3 * r + c] for r, c in near if 0 <= r < 3 and 0 <= c < 3]


def _table(rows: dict[str, list[str]], key: Column) -> Column:
    pairs = [x for name, values in rows.items() for x in (F.lit(name), literal_array(values))]
    return F.try_element_at(F.create_map(*pairs), key)


def cell_neighbours(cell: Column) -> Column:
    """The cells one step away: up, down, left, right."""
    return _table({c: _near(c) for c in CELLS}, cell)


def yaw_position(yaw: Column) -> Column:
    return F.array_position(literal_array(YAW_BINS), F.upper(yaw)).cast("int") - 1


def yaw_steps(a: Column, b: Column) -> Column:
    """Steps between two bins around the ring of eight."""
    d = F.abs(yaw_position(a) - yaw_position(b))
    return F.least(d, 8 - d)


def yaw_neighbours(yaw: Column) -> Column:
    """The two bins beside this one: counter-clockwise, clockwise."""
    ring = {b: [YAW_BINS[i - 1], YAW_BINS[(i + 1) % 8]] for i, b in enumerate(YAW_BINS)}
    return _table(ring, F.upper(yaw))


def yaw_bin(radians: Column) -> Column:
    """The nearest of eight 45-degree bins. Angles midway between two bins may fall in either."""
    wedge = F.floor(F.pmod(radians + F.lit(math.pi / 8), F.lit(2 * math.pi)) / F.lit(math.pi / 4))
    return F.get(literal_array(YAW_BY_ANGLE), F.pmod(wedge.cast("int"), F.lit(8)))


def height_bin(metres: Column) -> Column:
    return F.when(metres >= Z_HIGH_MIN, "HIGH").when(metres >= Z_MID_MIN, "MID").otherwise("LOW")
