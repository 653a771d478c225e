"""Typed parameters of the mapping queries: 22 keys, immutable, all required in a file."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Parameters:
    resolution_local_map: float = 0.05
    grid_center_x: float = 0.0
    grid_center_y: float = 0.0
    half_size_traversability: float = 7.5
    extend_length_every_resize_by: float = 30.0
    robot_radius: float = 0.20
    ground_clearance: float = 0.15
    max_slope: float = 0.4
    min_points_per_grid: int = 3
    is_kf_optimization_enabled: bool = True
    num_local_keyframes: int = 10
    global_adjustment_sleep: float = 0.0
    inflation_enabled: bool = False
    inflation_radius: float = 1.5
    inflation_cost_scaling: float = 2.0
    inflation_lethal: float = 0.95
    robot_height: float = 3.5
    max_range: float = 6.0
    min_range: float = 1.0
    use_pointcloud_buffer: bool = False
    use_ros_buffer: bool = False
    publish_rate_hz: float = 1.0

    def get(self, key: str) -> Any:
        name = KEYS.get(key)
        if name is None:
            raise KeyError(f"no parameter {key}")
        return getattr(self, name)

    def with_values(self, values: dict[str, Any]) -> Parameters:
        """A copy with some keys set; unknown keys and values of another type are errors (an int may stand for a float)."""
        new = {}
        for key, value in values.items():
            if key not in KEYS:
                raise KeyError(f"no parameter {key}")
            want = type(getattr(self, KEYS[key]))
            if want is float and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
            if type(value) is not want:
                raise TypeError(f"{key} is a {want.__name__}, not {type(value).__name__}")
            new[KEYS[key]] = value
        return replace(self, **new)

    def items(self) -> dict[str, Any]:
        held = asdict(self)
        return {key: held[name] for key, name in KEYS.items()}


# The keys as parameter files name them.
KEYS: dict[str, str] = {
    "grid/resolution_local_map": "resolution_local_map", "grid/grid_center_x": "grid_center_x", "grid/grid_center_y": "grid_center_y", "grid/half_size_traversability": "half_size_traversability",
    "grid/extend_length_every_resize_by": "extend_length_every_resize_by", "traversability/robot_radius": "robot_radius", "traversability/ground_clearance": "ground_clearance", "traversability/max_slope": "max_slope",
    "traversability/min_points_per_grid": "min_points_per_grid", "mapping/is_kf_optimization_enabled": "is_kf_optimization_enabled", "mapping/num_local_keyframes": "num_local_keyframes", "mapping/global_adjustment_sleep": "global_adjustment_sleep",
    "inflation/enabled": "inflation_enabled", "inflation/radius": "inflation_radius", "inflation/cost_scaling": "inflation_cost_scaling", "inflation/lethal": "inflation_lethal", "pointcloud/robot_height": "robot_height",
    "pointcloud/max_range": "max_range", "pointcloud/min_range": "min_range", "pointcloud/use_pointcloud_buffer": "use_pointcloud_buffer", "pointcloud/use_ros_buffer": "use_ros_buffer", "node/publish_rate_hz": "publish_rate_hz",
}
assert set(KEYS.values()) == {f.name for f in fields(Parameters)}

GLOBAL = Parameters()
LOCAL = Parameters(half_size_traversability=10.0, min_points_per_grid=5, inflation_enabled=True, inflation_radius=0.5, inflation_cost_scaling=3.0, publish_rate_hz=10.0)
ONE_SHOT = Parameters(half_size_traversability=40.0, extend_length_every_resize_by=40.0, min_points_per_grid=5, is_kf_optimization_enabled=False, num_local_keyframes=1, inflation_enabled=True, inflation_radius=0.5, inflation_cost_scaling=3.0, robot_height=1e9, max_range=1e9, min_range=0.0)
