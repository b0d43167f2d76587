"""Parameters with their defaults, path layout, and result names by parameter hash."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass
class SnapshotConfig:
    normalize: bool = True
    z_bin_size: float = 0.05
    r_bin_size: float = 2.0
    detection_threshold: float = 0.5


@dataclass
class ImageConfig:
    align: bool = False
    background_fill: float = 1.0
    detection_threshold: float = 0.5
    detection_mode: str = "composed"
    filter_sizes: list[int] = field(default_factory=lambda: [10, 20, 40])
    small_hole_size: int = 1800

    def __post_init__(self):
        if self.detection_mode not in ("max", "composed"):
            raise ValueError(f"detection_mode must be 'max' or 'composed', not {self.detection_mode!r}")
        if self.background_fill != self.background_fill:
            raise ValueError("background_fill must be a number")
        if not isinstance(self.filter_sizes, list) or not all(isinstance(s, int) for s in self.filter_sizes):
            raise TypeError("filter_sizes must be a list of integers")


@dataclass
class InnerConfig:
    peel_iteration: int = 5
    threshold: float = 0.2
    max_group_size: int = 1_000_000
    min_component_size: int = 5
    component_iteration_size_factor: float = 0
    enforce_terminal_bijection: bool = False
    single_connect: int = 1
    connect: int = 1


@dataclass
class ShellConfig:
    inner_connect: int = 1
    connect: int = 2
    max_layer: int = 6
    max_iter: int = 3
    pair_order: str = "density"


def config_hash(inner: InnerConfig, shell: ShellConfig | None = None, **more) -> str:
    """First eight hex digits of the md5 of all parameters as sorted JSON; shell parameters only where shells are made."""
    every = {"inner": asdict(inner), **({"shell": asdict(shell)} if shell else {}), **more}
    return hashlib.md5(json.dumps(every, sort_keys=True).encode()).hexdigest()[:8]


def result_path(root: str, snapshot: int | str, model: str, inner: InnerConfig, shell: ShellConfig | None = None, suffix: str = "inner") -> str:
    """Folder of one grouping result."""
    return f"{root.rstrip('/')}/groups_{snapshot}_{suffix}_{model}_{config_hash(inner, shell)}{'' if shell else '_unshelled'}"


def score_path(root: str, snapshot: int | str, model: str, suffix: str = "inner") -> str:
    return f"{root.rstrip('/')}/scores_{snapshot}_{suffix}_{model}"


_CHUNK = re.compile(r"(\d+)_(\d+)_(-?[\d.]+)_(-?[\d.]+)_sec")


def parse_chunk_name(name: str) -> tuple[int, int]:
    """(snapshot, section) of a chunk file's name."""
    found = _CHUNK.search(name)
    if not found:
        raise ValueError(f"not a chunk name: {name}")
    return int(found[1]), int(found[2])


def check_intervals(intervals: list[tuple[float, float]], low: float, high: float, tolerance: float = 1e-6) -> None:
    """Raise unless the intervals, in order of their starts, run from low to high without a gap."""
    ends = low
    for a, b in sorted(intervals):
        if abs(a - ends) > tolerance:
            raise ValueError(f"chunk borders {ends} and {a} don't meet")
        ends = b
    if abs(ends - high) > tolerance:
        raise ValueError(f"chunks end at {ends}, not at {high}")


def load_config(path: str | Path) -> dict:
    """YAML with its chain of base_config files merged in, nested values of the later file over those of its base."""
    import yaml

    own = yaml.safe_load(Path(path).read_text()) or {}
    base = own.pop("base_config", None)
    return merged(load_config(Path(path).parent / base), own) if base else own


def merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
