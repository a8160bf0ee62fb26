"""The YAML configuration and its checks; all on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache
from pathlib import Path

import yaml

SECTIONS = ("common", "asr", "predictive", "text", "features")


@lru_cache(maxsize=8)
def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        found = yaml.safe_load(file)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a mapping")
    return found


def load_config(path: str | Path) -> dict:
    """The whole file; kept by its resolved path until ``forget_configs``."""
    return _load(str(Path(path).expanduser().resolve()))


forget_configs = _load.cache_clear


def section(config: Mapping, name: str) -> dict:
    found = config.get(name)
    if not isinstance(found, dict):
        raise ValueError(f"section {name} is missing or not a mapping")
    return found


def require(config: Mapping, key: str, where: str = "", kind: type | None = None):
    """The value of a key that must be there, and of a type if one is named."""
    if config.get(key) is None:
        raise KeyError(f"{where}{key} is missing")
    if kind is not None and not isinstance(config[key], kind):
        raise ValueError(f"{where}{key} is not a {kind.__name__}")
    return config[key]


def names(value: object) -> list[str] | None:
    """A list of stripped names; null, an empty list or a blank text mean none; a single value is a list of one."""
    if value is None:
        return None
    items = value if isinstance(value, (list, tuple)) else [value]
    out = [str(x).strip() for x in items if x is not None and str(x).strip()]
    return out or None


def sampling(config: Mapping) -> dict:
    """balance, cap_per_class and subset_seed, checked."""
    balance, cap, seed = config.get("balance", False), config.get("cap_per_class"), config.get("subset_seed")
    if not isinstance(balance, bool):
        raise ValueError("balance must be true or false")
    for key, value in (("cap_per_class", cap), ("subset_seed", seed)):
        if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
            raise ValueError(f"{key} must be a whole number from 0")
    if (balance or cap is not None) and seed is None:
        raise ValueError("sampling needs subset_seed")
    return {"balance": balance, "cap": cap, "seed": seed}


def train_balance(config: Mapping | None) -> dict:
    config = config or {}
    strategy = str(config.get("strategy", "none")).strip().lower() if config.get("enabled", False) else "none"
    if strategy not in ("none", "downsample", "upsample"):
        raise ValueError(f"unknown balancing: {strategy}")
    return {"balance": strategy, "seed": int(config.get("random_state") or 0)}


def device(wanted: str | None, available: bool) -> str:
    """auto takes an accelerator if there is one; a wanted one that isn't there falls back to the CPU."""
    wanted = (wanted or "auto").strip().lower()
    if wanted in ("auto", "cuda") or wanted.startswith("cuda:"):
        return (wanted if wanted != "auto" else "cuda") if available else "cpu"
    return wanted
