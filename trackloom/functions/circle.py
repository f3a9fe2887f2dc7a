"""Geometry of twelve classes on a circle, and of 24 on two circles."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ------------------------------------------------------------
KEYS = 12
MODES = 2
JOINT_CLASSES = KEYS * MODES
ORDERINGS = ["chromatic", "fifths"]
FIFTHS_STEP = 7
KERNELS = ["gaussian_squared", "gaussian_linear"]
# Training weight of a row whose prediction lies 0, 1, 2, 3, 4 or more steps off.
ERROR_WEIGHTS = [1.0, 1.25, 1.5, 1.75, 2.0]

TWO_PI = 2.0 * math.pi


def circular_distance(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.least(gap, F.lit(KEYS) - gap)


def position(key: Column, ordering: str = "chromatic") -> Column:
    if ordering == "chromatic":
        return key
    if ordering == "fifths":
        return F.pmod(key * FIFTHS_STEP, F.lit(KEYS))
    raise ValueError(f"unknown ordering {ordering!r}, expected one of {ORDERINGS}")


def angle(key: Column, ordering: str = "chromatic") -> Column:
    return position(key, ordering) * F.lit(TWO_PI) / F.lit(KEYS)


def mode_height(mode: Column) -> Column:
    return F.when(mode >= 1, 1.0).otherwise(-1.0)


def key_to_xy(key: Column, ordering: str = "chromatic") -> tuple[Column, Column]:
    return F.cos(angle(key, ordering)), F.sin(angle(key, ordering))


def key_mode_to_xyz(key: Column, mode: Column) -> tuple[Column, Column, Column]:
    x, y = key_to_xy(key)
    return x, y, mode_height(mode)


def xyz_to_key(x: Column, y: Column) -> Column:
    turn = F.pmod(F.atan2(y, x), F.lit(TWO_PI))
    return F.pmod(F.rint(turn * KEYS / F.lit(TWO_PI)).cast("int"), F.lit(KEYS))


def z_to_mode(z: Column) -> Column:
    return F.when(z >= 0, 1).otherwise(0)


def joint_class(key: Column, mode: Column) -> Column:
    return mode.cast("int") * KEYS + key.cast("int")


def joint_key(joint: Column) -> Column:
    return joint % KEYS


def joint_mode(joint: Column) -> Column:
    return F.floor(joint / KEYS).cast("int")


def chord(a: Column, b: Column, ordering: str = "chromatic") -> Column:
    """Straight-line distance of two keys on the unit circle."""
    ax, ay = key_to_xy(a, ordering)
    bx, by = key_to_xy(b, ordering)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def joint_chord(key_a: Column, mode_a: Column, key_b: Column, mode_b: Column) -> Column:
    flat = chord(key_a, key_b)
    rise = mode_height(mode_a) - mode_height(mode_b)
    return F.sqrt(flat * flat + rise * rise)


def error_weight(distance: Column) -> Column:
    expr = F.lit(ERROR_WEIGHTS[-1])
    for steps in reversed(range(len(ERROR_WEIGHTS) - 1)):
        expr = F.when(distance == steps, ERROR_WEIGHTS[steps]).otherwise(expr)
    return expr


# The class space has 12 or 24 points, so its matrices are plan constants.

def distance_matrix(space: str = "key", ordering: str = "chromatic") -> list[list[float]]:
    """``key`` (12 points in the plane), ``joint`` (24 in space) or ``steps``."""
    if space == "steps":
        return [[float(min(abs(a - b), KEYS - abs(a - b))) for b in range(KEYS)] for a in range(KEYS)]
    step = {"chromatic": 1, "fifths": FIFTHS_STEP}[ordering]

    def point(c):
        turn = TWO_PI * ((c % KEYS) * step % KEYS) / KEYS
        height = (1.0 if c >= KEYS else -1.0) if space == "joint" else 0.0
        return math.cos(turn), math.sin(turn), height

    size = JOINT_CLASSES if space == "joint" else KEYS
    return [[math.dist(point(a), point(b)) for b in range(size)] for a in range(size)]


def soft_targets(distances: list[list[float]], alpha: float, beta: float,
                 kernel: str = "gaussian_squared") -> list[list[float]]:
    """Row-stochastic mix of the one-hot label and a distance kernel."""
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}, expected one of {KERNELS}")
    power = 2 if kernel == "gaussian_squared" else 1
    mixed = []
    for true_class, row in enumerate(distances):
        weights = [math.exp(-beta * d ** power) for d in row]
        share = alpha / sum(weights)
        mixed.append([w * share + (1.0 - alpha) * (c == true_class) for c, w in enumerate(weights)])
    return mixed


def as_literal(matrix: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])
