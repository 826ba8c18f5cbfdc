"""Experiment configuration: inheritance of YAML files, validation, overrides, fingerprints."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

MOST_LEVELS = 10


class ConfigError(ValueError):
    """A configuration breaks a rule."""


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` wins; mappings merge, lists and scalars replace."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def resolve(path: str | Path, trail: tuple[Path, ...] = ()) -> dict:
    """A YAML file with its bases (``_base``: a path or list of paths, left to right) merged below it."""
    import yaml

    path = Path(path).resolve()
    if path in trail:
        raise ConfigError(f"{path} is among its own bases")
    if len(trail) > MOST_LEVELS:
        raise ConfigError(f"more than {MOST_LEVELS} levels of bases")
    own = yaml.safe_load(path.read_text()) or {}
    if not isinstance(own, dict):
        raise ConfigError(f"{path} is not a mapping")
    bases = own.pop("_base", [])
    own.pop("_partial", None)
    if isinstance(bases, str):
        bases = [bases]
    if not all(isinstance(b, str) for b in bases):
        raise ConfigError(f"bases of {path} are not paths")
    merged: dict = {}
    for b in bases:
        merged = deep_merge(merged, resolve(path.parent / b, (*trail, path)))
    return deep_merge(merged, own)


@dataclass(frozen=True)
class Labels:
    source: str = "auto"
    return_type: str = "smoothed_return"
    horizons: tuple[int, ...] = ()
    primary_index: int | None = 0
    threshold_bps: float = 8.0
    task: str = "auto"
    weights: str = "none"

    def __post_init__(self):
        _one_of("source", self.source, ("auto", "precomputed", "forward_prices"))
        _one_of("return_type", self.return_type, ("smoothed_return", "point_return", "mean_return", "peak_return", "forward_variance"))
        _one_of("task", self.task, ("auto", "classification", "regression"))
        _one_of("weights", self.weights, ("none", "concurrent_overlap"))
        if any(h < 1 for h in self.horizons) or len(set(self.horizons)) != len(self.horizons):
            raise ConfigError("horizons are distinct positive numbers")
        if self.primary_index is not None and (self.primary_index < 0 or (self.horizons and self.primary_index >= len(self.horizons))):
            raise ConfigError("primary_index is not among the horizons")
        if self.threshold_bps < 0:
            raise ConfigError("threshold_bps is negative")


@dataclass(frozen=True)
class Data:
    path: str = ""
    preset: str | None = None
    indices: tuple[int, ...] = ()
    normalization: str = "hybrid"
    clip: float = 10.0
    layout: str = "grouped"
    labels: Labels = field(default_factory=Labels)

    def __post_init__(self):
        _one_of("normalization", self.normalization, ("none", "global_zscore", "hybrid", "zscore", "zscore_per_day", "minmax", "robust"))
        if self.preset and self.indices:
            raise ConfigError("preset and indices exclude each other")
        if self.clip <= 0:
            raise ConfigError("clip is not positive")


@dataclass(frozen=True)
class Model:
    kind: str = "logistic"
    classes: int = 3
    alpha: float = 1.0
    trees: int = 200

    def __post_init__(self):
        if self.trees < 1:
            raise ConfigError("there is at least one tree")
        _one_of("kind", self.kind, ("logistic", "ridge", "boosting", "class_prior", "previous_label"))
        if self.classes < 2:
            raise ConfigError("there are at least two classes")


@dataclass(frozen=True)
class Train:
    epochs: int = 50
    learning_rate: float = 1e-3
    scheduler: str = "cosine"
    seed: int = 42

    def __post_init__(self):
        _one_of("scheduler", self.scheduler, ("cosine", "step", "plateau", "none"))
        if self.epochs < 1 or self.learning_rate <= 0 or not 0 <= self.seed < 2**32:
            raise ConfigError("epochs, learning_rate or seed are out of range")


@dataclass(frozen=True)
class CrossValidation:
    folds: int = 5
    embargo_days: int = 1

    def __post_init__(self):
        if self.folds < 2 or self.embargo_days < 0:
            raise ConfigError("at least two folds and an embargo of 0 or more days")


@dataclass(frozen=True)
class Experiment:
    name: str = "experiment"
    hypothesis: str = ""
    tags: tuple[str, ...] = ()
    gates: dict[str, float] = field(default_factory=dict)
    data: Data = field(default_factory=Data)
    model: Model = field(default_factory=Model)
    train: Train = field(default_factory=Train)
    cv: CrossValidation | None = None

    def warnings(self) -> list[str]:
        return [f"{k} is missing" for k in ("name", "hypothesis") if not getattr(self, k)]


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ConfigError(f"{name} {value!r} is not one of {', '.join(allowed)}")


_NESTED = {"data": Data, "labels": Labels, "model": Model, "train": Train, "cv": CrossValidation}


def build(kind: type, values: dict) -> Any:
    """A frozen configuration from mappings; unknown keys are errors."""
    known = {f.name for f in fields(kind)}
    if unknown := values.keys() - known:
        raise ConfigError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    return kind(**{k: build(_NESTED[k], v) if k in _NESTED and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load(path: str | Path) -> Experiment:
    return build(Experiment, resolve(path))


def override(config: Any, dotted: dict[str, Any]) -> Any:
    """Values by dotted name, with the rules of each part checked again."""
    for name, value in dotted.items():
        head, _, rest = name.partition(".")
        if not is_dataclass(config) or head not in {f.name for f in fields(config)}:
            raise ConfigError(f"there is no {name}")
        config = replace(config, **{head: override(getattr(config, head), {rest: value}) if rest else value})
    return config


def fingerprint(config: Any) -> str:
    """SHA-256 of the canonical JSON."""
    body = asdict(config) if is_dataclass(config) else config
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def require_same(saved: str, config: Any) -> None:
    if saved != fingerprint(config):
        raise ConfigError("the checkpoint belongs to another configuration")
