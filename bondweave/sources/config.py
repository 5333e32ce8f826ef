"""Configuration as YAML: load, merge, save."""

from __future__ import annotations

from pathlib import Path

import yaml


def load(path: str) -> dict:
    """A YAML mapping; an empty file is an empty one. Only plain values are accepted."""
    got = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(got, dict):
        raise TypeError(f"{path} holds no mapping")
    return got


def save(config: dict, path: str) -> None:
    Path(path).write_text(yaml.safe_dump(config, sort_keys=False))


def merge(base: dict, changes: dict, replace: bool = False) -> dict:
    """``base`` with ``changes``: nested mappings merge, other values are taken over. Unknown keys are an error
    unless ``replace`` is set, which also replaces nested mappings whole."""
    out = dict(base)
    for k, v in changes.items():
        if k not in base and not replace:
            raise KeyError(k)
        nested = isinstance(v, dict) and isinstance(base.get(k), dict) and not replace
        out[k] = merge(base[k], v) if nested else v
    return out
