"""Times and rigid transforms as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AFFINE = ["r00", "r01", "r02", "r10", "r11", "r12", "r20", "r21", "r22", "tx", "ty", "tz"]


def ns_to_sec(ns: Column) -> Column:
    """Whole seconds plus the rest, so large times lose nothing of their seconds."""
    rest = F.pmod(ns, F.lit(1_000_000_000).cast("long"))
    return ((ns - rest) / 1_000_000_000).cast("long").cast("double") + rest * 1e-9


def with_affine(df: DataFrame, qw: str = "qw", qx: str = "qx", qy: str = "qy", qz: str = "qz") -> DataFrame:
    """The rotation of a quaternion as nine columns; the quaternion is taken as it is, not normalised."""
    w, x, y, z = map(F.col, (qw, qx, qy, qz))
    return df.withColumns({
        "r00": 1 - 2 * (y * y + z * z), "r01": 2 * (x * y - w * z), "r02": 2 * (x * z + w * y), "r10": 2 * (x * y + w * z), "r11": 1 - 2 * (x * x + z * z), "r12": 2 * (y * z - w * x),
        "r20": 2 * (x * z - w * y), "r21": 2 * (y * z + w * x), "r22": 1 - 2 * (x * x + y * y),
    })


def transformed(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point by the pose columns of its row."""
    c = {n: F.col(n) for n in AFFINE}
    return tuple(c[f"r{i}0"] * x + c[f"r{i}1"] * y + c[f"r{i}2"] * z + c[f"t{'xyz'[i]}"] for i in range(3))


def matrix(translation: tuple[float, float, float], quaternion: tuple[float, float, float, float]) -> np.ndarray:
    """A 4x4 pose on the driver, for extrinsics that are configuration."""
    w, x, y, z = quaternion
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = translation
    return m


def composed(base_from_slam: np.ndarray, slam_from_sensor: np.ndarray) -> np.ndarray:
    return base_from_slam @ slam_from_sensor


def yaw_of(qw: Column, qx: Column, qy: Column, qz: Column) -> Column:
    return F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))


def turned(x: Column, y: Column, yaw: Column) -> tuple[Column, Column]:
    return F.cos(yaw) * x - F.sin(yaw) * y, F.sin(yaw) * x + F.cos(yaw) * y
