"""Settings of a store and of the lifecycle tasks: defaults, a TOML file, environment variables, then explicit values."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "ENGRAM_"


@dataclass
class Config:
    dimension: int = 384
    rrf_k: int = 60
    discovery_threshold: float = 0.7
    discovery_neighbors: int = 5
    promote_accesses: int = 3
    decay_per_day: float = 0.995
    hard_forget: bool = False
    retention_days: int = 30
    queue_size: int = 10_000
    workers: int = 1
    buckets: int = 16
    compact_after: int = 4
    production: bool = False
    checkpoint_dir: str = ""

    @classmethod
    def of(cls, values: Mapping) -> Config:
        """From a mapping; unknown names are an error."""
        kinds = {f.name: f.type for f in fields(cls)}
        if unknown := set(values) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: _read(k, kinds[k], v) for k, v in values.items()}).validated()

    @classmethod
    def load(cls, path: str | None = None, env: Mapping[str, str] | None = None, **explicit) -> Config:
        """From a TOML file, over it variables such as ENGRAM_RRF_K, over those explicit values."""
        values: dict = {}
        if path is not None:
            with open(path, "rb") as file:
                values |= tomllib.load(file)
        for name, value in (os.environ if env is None else env).items():
            if name.startswith(PREFIX) and (key := name[len(PREFIX) :].lower()) in {f.name for f in fields(cls)}:
                values[key] = value
        return cls.of(values | explicit)

    def validated(self) -> Config:
        if not 0 <= self.discovery_threshold <= 1:
            raise ValueError("discovery_threshold must be from 0 to 1")
        if not 0 < self.decay_per_day <= 1:
            raise ValueError("decay_per_day must be above 0 and at most 1")
        if min(self.dimension, self.rrf_k, self.discovery_neighbors, self.retention_days, self.queue_size, self.workers, self.buckets, self.compact_after) < 1:
            raise ValueError("counts must be positive")
        if self.production and not self.checkpoint_dir:
            raise ValueError("in production checkpoint_dir must name a folder that driver and executors share")
        return self


def _read(name: str, kind: str, value):
    """A value of the setting's type; a text is read, as environment variables are texts."""
    try:
        if kind == "bool" and isinstance(value, str):
            return {"true": True, "1": True, "false": False, "0": False}[value.strip().lower()]
        if kind in ("int", "float") and isinstance(value, bool):
            raise ValueError
        return {"int": int, "float": float, "bool": bool, "str": str}[kind](value)
    except (KeyError, TypeError, ValueError):
        raise ValueError(f"{name} can't be {value!r}") from None
