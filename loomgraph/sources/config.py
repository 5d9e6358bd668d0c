"""Settings from a chain of TOML tables: built-in ones, the store's, the working folder's, explicit ones; the later wins, key by key."""

from __future__ import annotations

import math
import tomllib
from pathlib import Path

#: Fixed value: the largest weight.
MOST = 1e9


def number(name: str, value: object) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or not 0 <= value <= MOST:
        raise ValueError(f"{name} must be a number from 0 to {MOST:g}")
    return float(value)


def merged(defaults: dict, *layers: dict) -> dict:
    """defaults with each layer's keys; maps merge name by name; unknown keys and values of another type are refused."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in defaults.items()}
    for layer in layers:
        for key, value in layer.items():
            if key not in defaults:
                raise ValueError(f"unknown setting {key}")
            known = defaults[key]
            if isinstance(known, dict):
                if not isinstance(value, dict):
                    raise ValueError(f"{key} must be a table")
                out[key].update({name: number(f"{key}.{name}", v) for name, v in value.items()})
            elif isinstance(known, bool) or isinstance(known, str | list):
                if type(value) is not type(known):
                    raise ValueError(f"{key} must be of type {type(known).__name__}")
                out[key] = value
            else:
                out[key] = number(key, value)
    return out


def read(path: str, table: str) -> dict:
    """One table of a TOML file; a missing file or table is empty."""
    file = Path(path)
    return tomllib.loads(file.read_text()).get(table, {}) if file.is_file() else {}


def chain(table: str, defaults: dict, *paths: str) -> tuple[dict, str]:
    """The settings in effect, and the last file that gave any (`defaults` if none)."""
    layers = [(p, read(p, table)) for p in paths]
    used = [p for p, layer in layers if layer]
    return merged(defaults, *(layer for _, layer in layers)), used[-1] if used else "defaults"
