"""Pipeline and benchmark configurations from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml


@dataclass
class Step:
    name: str
    enabled: bool = True
    parameters: dict = field(default_factory=dict)


@dataclass
class Pipeline:
    pcd_file_path: str
    voxel_downsample: bool = False
    voxel_size: float = 0.1
    visualize: bool = False
    final_visualize: bool = False
    steps: list[Step] = field(default_factory=list)


def pipeline(source: str | dict) -> Pipeline:
    """From a file's path, YAML text or its parsed form, with or without the ros__parameters level."""
    raw = source
    if isinstance(source, str):
        if "\n" in source:
            raw = yaml.safe_load(source)
        else:
            with open(source) as f:
                raw = yaml.safe_load(f)
    while "ros__parameters" not in raw and len(raw) == 1 and isinstance(next(iter(raw.values())), dict):
        raw = next(iter(raw.values()))
    raw = raw.get("ros__parameters", raw)
    steps = [Step(s["step"], bool(s.get("enabled", True)), dict(s.get("parameters") or {})) for s in raw.get("pipeline") or []]
    return Pipeline(raw["pcd_file_path"], bool(raw.get("voxel_downsample_pointcloud", False)), float(raw.get("voxel_size", 0.1)), bool(raw.get("visualize", False)), bool(raw.get("final_visualize", raw.get("final_result_visualization", False))), steps)


@dataclass
class Benchmark:
    """Simulations times algorithms over made-up terrain, or one cloud."""

    num_simulations: int = 20
    terrain_size: float = 20.0
    min_radius: float = 2.5
    max_slope: float = 25.0
    min_density: float = 30.0
    max_relief: float = 0.25
    max_roughness: float = 0.02
    max_landing_zones: int = 1
    max_attempts: int = 10_000
    algorithms: list[dict] = field(default_factory=list)
    pcd_file_path: str | None = None


#: Keys of benchmark files, without regard to case, underscores and a last `_threshold`, that have another name here.
_ALIAS = {"minpointdensity": "min_density"}
#: Keys that say nothing to an engine without a viewer, or are read beside the others.
_PASSED_OVER = {"enablevisualization", "usepcdfile"}


def benchmark(source: str | dict) -> Benchmark:
    """Keys are matched without regard to case and underscores, as files differ in both, and with or without `_threshold`.
    They may stand in nested mappings; a key that is not known raises.  Each algorithm has a name and its own parameters."""
    raw = source
    if isinstance(source, str):
        if "\n" in source:
            raw = yaml.safe_load(source)
        else:
            with open(source) as f:
                raw = yaml.safe_load(f)
    known = {n.replace("_", ""): n for n in Benchmark.__dataclass_fields__} | _ALIAS
    out: dict = {}

    def walk(level: dict) -> None:
        for key, value in level.items():
            plain = str(key).lower().replace("_", "")
            name = known.get(plain) or known.get(plain.removesuffix("threshold"))
            if name:
                out[name] = value
            elif isinstance(value, dict):
                walk(value)
            elif plain not in _PASSED_OVER:
                raise ValueError(f"unknown key {key!r}")

    walk(raw)
    if not raw.get("use_pcd_file", True):
        out.pop("pcd_file_path", None)
    return Benchmark(**out)
