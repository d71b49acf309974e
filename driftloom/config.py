"""Parameters of a run in four groups, their bounds as a table, and the study's JSON files."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields

# Seeds of the study, and each data set's rows, width, classes and deltas from the defaults.
SEEDS = (7, 13, 19, 23, 31, 37, 41, 43, 47, 53)
DATASETS = {
    "covertype": {"rows": 581012, "width": 54, "classes": 7, "radius": 1.5, "window": 1000, "projected": 32},
    "electricity": {"rows": 45312, "width": 8, "classes": 2, "radius": 1.0, "window": 1000, "projected": 32},
    "tweeteval": {"rows": 59899, "width": 2048, "classes": 3, "radius": 0.85, "window": 2000, "projected": 256},
    "synthetic_gmm": {"rows": 9000, "width": 256, "classes": 4, "radius": 1.5, "window": 1000, "projected": 32},
}


@dataclass(frozen=True)
class Projection:
    """Input of `width` dims to `size` dims; kind is sparse, dense or identity.  Without a seed of its own it takes the run's."""

    width: int
    size: int = 32
    kind: str = "sparse"
    sparsity: int = 3
    seed: int | None = None


@dataclass(frozen=True)
class Admission:
    """Who enters the sketch: mode is sample, uniform, weight or off; a window of scores is the norm."""

    mode: str = "sample"
    rate: float = 0.65
    floor: float = 0.05
    least: float = 0.15
    most: float = 1.0
    lightest: float = 0.35
    heaviest: float = 3.0
    ridge: float = 1e-3
    window: int = 1000


@dataclass(frozen=True)
class Rank:
    """How the basis follows the sketch: every `interval` admissions, by energy, error threshold and patience."""

    first: int = 8
    least: int = 4
    most: int = 32
    energy: float = 0.95
    tolerance: float = 0.04
    patience: int = 4
    smoothing: float = 0.90
    interval: int = 100


@dataclass(frozen=True)
class Clusters:
    """Micro-clusters: adapted says whether they live in the basis; shrink is the exponent of the weight's pull on the radius."""

    radius: float = 1.5
    decay: float = 0.95
    capacity: int = 200
    prune: str = "utility"
    adapted: bool = True
    shrink: float = 0.25


# The public parameter names of a run, and where each is kept.
NAMES = {
    "original_dim": "projection.width",
    "projection_dim": "projection.size",
    "projection_mode": "projection.kind",
    "projection_sparsity": "projection.sparsity",
    "projection_seed": "projection.seed",
    "window_size": "admission.window",
    "leverage_mode": "admission.mode",
    "leverage_sampling_rate": "admission.rate",
    "uniform_floor": "admission.floor",
    "min_sampling_probability": "admission.least",
    "max_sampling_probability": "admission.most",
    "min_leverage_weight": "admission.lightest",
    "max_leverage_weight": "admission.heaviest",
    "leverage_regularization": "admission.ridge",
    "initial_rank": "rank.first",
    "min_rank": "rank.least",
    "max_rank": "rank.most",
    "retained_energy": "rank.energy",
    "rank_tolerance": "rank.tolerance",
    "stable_intervals_before_shrink": "rank.patience",
    "threshold_smoothing": "rank.smoothing",
    "basis_update_interval": "rank.interval",
    "microcluster_radius": "clusters.radius",
    "decay": "clusters.decay",
    "max_microclusters": "clusters.capacity",
    "prune_policy": "clusters.prune",
    "adapt_for_clustering": "clusters.adapted",
    "leverage_radius_strength": "clusters.shrink",
    "seed": "seed",
}

# What a value must be: (at least, at most) with the lower end open where it is marked, or one of some words.
BOUNDS = {
    "original_dim": (1, math.inf),
    "min_rank": (1, "initial_rank"),
    "initial_rank": (1, "max_rank"),
    "max_rank": (1, "projection_dim"),
    "window_size": ("max_rank", math.inf),
    "projection_sparsity": (1, math.inf),
    "basis_update_interval": (1, math.inf),
    "decay": (0.0, 1.0),
    "threshold_smoothing": (0.0, 1.0),
    "retained_energy": (0.0, 1.0),
    "min_sampling_probability": (0.0, "max_sampling_probability"),
    "max_sampling_probability": (0.0, 1.0),
    "min_leverage_weight": (0.0, "max_leverage_weight"),
}
OPEN_BELOW = {"decay", "retained_energy", "min_sampling_probability", "min_leverage_weight"}
OPEN_ABOVE = {"threshold_smoothing"}
WORDS = {
    "projection_mode": ("sparse", "dense", "identity"),
    "leverage_mode": ("sample", "uniform", "weight", "off"),
    "prune_policy": ("utility", "merge"),
}


@dataclass(frozen=True)
class StreamConfig:
    """One adaptive-subspace run; `flat` takes the public names, and a broken rule raises ValueError."""

    projection: Projection
    admission: Admission = field(default_factory=Admission)
    rank: Rank = field(default_factory=Rank)
    clusters: Clusters = field(default_factory=Clusters)
    seed: int = 7

    def __post_init__(self) -> None:
        if broken := self.broken():
            raise ValueError("; ".join(broken))

    def broken(self) -> list[str]:
        """The rules that don't hold."""
        values, out = self.to_dict(), []
        for name, (low, high) in BOUNDS.items():
            a, b, v = values.get(low, low), values.get(high, high), values[name]
            if not a <= v <= b or (name in OPEN_BELOW and v == a) or (name in OPEN_ABOVE and v == b):
                out.append(f"{name} is between {low} and {high}, not {v}")
        out += [f"{name} is one of {words}" for name, words in WORDS.items() if values[name] not in words]
        if self.projection.kind == "identity" and self.projection.size != self.projection.width:
            out.append("an identity projection keeps the width")
        return out

    def to_dict(self) -> dict:
        """Values by public name."""
        out = {}
        for name, path in NAMES.items():
            group, _, part = path.rpartition(".")
            out[name] = getattr(getattr(self, group) if group else self, part)
        return out

    @classmethod
    def flat(cls, **values) -> StreamConfig:
        """A configuration from public names."""
        if unknown := sorted(set(values) - set(NAMES)):
            raise ValueError(f"unknown parameters: {unknown}")
        groups: dict[str, dict] = {f.name: {} for f in fields(cls)}
        for name, value in values.items():
            group, _, part = NAMES[name].rpartition(".")
            groups[group or "seed"][part] = value
        seed = groups.pop("seed")
        kinds = {"projection": Projection, "admission": Admission, "rank": Rank, "clusters": Clusters}
        return cls(**{g: kinds[g](**v) for g, v in groups.items()}, **seed)

    @classmethod
    def for_dataset(cls, name: str, width: int, seed: int, fixed_rank: bool = False, **more) -> StreamConfig:
        """The study's parameters for a data set; fixed_rank pins the rank at 8."""
        d = DATASETS[name]
        values = {"window_size": d["window"], "projection_dim": d["projected"], "microcluster_radius": d["radius"]}
        return cls.flat(**(values | study(width, seed, fixed_rank) | more))


def study(width: int, seed: int, fixed_rank: bool = False) -> dict:
    """What all runs of the study set apart from their data set's values: seeds, no pull on the radius, a pinned rank."""
    pinned = dict.fromkeys(("initial_rank", "min_rank", "max_rank"), 8) if fixed_rank else {}
    return {"original_dim": int(width), "seed": int(seed), "projection_seed": int(seed), "leverage_radius_strength": 0.0} | pinned


# The keys that a data set's JSON file must have besides its class count and settings of other methods.
STUDY_KEYS = (
    "projection_dim window_size initial_rank min_rank max_rank microcluster_radius decay threshold_smoothing "
    "leverage_regularization retained_energy projection_sparsity max_microclusters"
).split()


@dataclass(frozen=True)
class Study:
    """A data set's JSON file: its classes, the adaptive run's values by public name, and the settings of other methods."""

    dataset: str
    classes: int
    values: dict
    others: dict

    def config(self, width: int, seed: int, fixed_rank: bool = False, **more) -> StreamConfig:
        return StreamConfig.flat(**(self.values | study(width, seed, fixed_rank) | more))


def read_study(path: str, dataset: str | None = None) -> Study:
    """The study's file of one data set.  A missing file raises FileNotFoundError, a missing key ValueError; other keys are ignored."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    needed = [*STUDY_KEYS, "n_clusters", "baseline_settings"]
    if missing := [k for k in needed if k not in raw]:
        raise ValueError(f"{path} lacks {missing}")
    if dataset is not None and raw.get("dataset", dataset) != dataset:
        raise ValueError(f"{path} is of {raw['dataset']}, not of {dataset}")
    return Study(raw.get("dataset", dataset or ""), int(raw["n_clusters"]), {k: raw[k] for k in STUDY_KEYS}, raw["baseline_settings"])


# Overrides that make the ablation's variants, and the axes of the sensitivity grid (fixed values).
ABLATION = {
    "proposed": {},
    "fixed_rank": {"initial_rank": 8, "min_rank": 8, "max_rank": 8},
    "uniform_sampling": {"leverage_mode": "uniform"},
    "keep_all": {"leverage_mode": "off"},
    "dense_projection": {"projection_mode": "dense"},
    "leverage_weighting": {"leverage_mode": "weight"},
}
SENSITIVITY = {
    "original_dim": (64, 128, 256),
    "projection_dim": (16, 32, 48),
    "window_size": (500, 1000, 1500),
    "max_rank": (8, 16, 32),
    "max_microclusters": (100, 200, 300),
}


def clamped(values: dict) -> dict:
    """Ranks brought down to what the projection's size (and each other) allow."""
    config = {"projection_dim": 32, "max_rank": 32, "initial_rank": 8, "min_rank": 4} | values
    above = config["projection_dim"]
    for name in ("max_rank", "initial_rank", "min_rank"):
        above = config[name] = min(config[name], above)
    return config


def sensitivity_cells(base: dict) -> list[tuple[str, int, dict]]:
    """(axis, value, parameters) of the grid."""
    return [(axis, value, clamped(base | {axis: value})) for axis, values in SENSITIVITY.items() for value in values]
