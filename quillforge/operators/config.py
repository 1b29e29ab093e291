"""Configuration on the driver: composing nested settings, overrides, and the checks of parallel layouts."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any


def merged(base: dict, over: dict) -> dict:
    """base with over laid on it, mapping by mapping."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def parsed(value: str) -> Any:
    """The value of an override: JSON where it is JSON, else text; on and off are yes and no."""
    if value.lower() in ("on", "off"):
        return value.lower() == "on"
    try:
        return json.loads(value)
    except ValueError:
        return value


def composed(groups: dict[str, dict[str, dict]], defaults: dict[str, str], overrides: list[str] = ()) -> dict:
    """Settings from one choice of each group, then overrides: ``group=choice`` picks another, ``a.b=value`` sets a key. Text of the form
    ``${a.b}`` stands for another key."""
    chosen, keys = dict(defaults), {}
    for o in overrides:
        name, _, value = o.partition("=")
        if not _:
            raise ValueError(f"an override needs '=': {o!r}")
        if "." not in name and name in groups:
            chosen[name] = value
        else:
            keys[name] = parsed(value)
    out: dict = {}
    for group, choice in chosen.items():
        if choice not in groups.get(group, {}):
            raise ValueError(f"group {group!r} has no {choice!r}")
        out = merged(out, {group: groups[group][choice]})
    for name, value in keys.items():
        for part in reversed(name.split(".")):
            value = {part: value}
        out = merged(out, value)
    return resolved(out, out)


def resolved(node: Any, root: dict, depth: int = 0) -> Any:
    if depth > 32:
        raise ValueError("settings refer to each other in a circle")
    if isinstance(node, dict):
        return {k: resolved(v, root, depth) for k, v in node.items()}
    if isinstance(node, list):
        return [resolved(v, root, depth) for v in node]
    if isinstance(node, str) and node.startswith("${") and node.endswith("}"):
        value: Any = root
        for part in node[2:-1].split("."):
            if not isinstance(value, dict) or part not in value:
                raise ValueError(f"no setting {node[2:-1]!r}")
            value = value[part]
        return resolved(value, root, depth + 1)
    return node


def digest(settings: dict) -> str:
    """sha256 of the settings in canonical form."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def device_groups(devices: list[int], each: int) -> list[list[int]]:
    """Devices in groups of ``each``, one group a shard."""
    if each <= 0 or len(devices) % each or len(set(devices)) != len(devices):
        raise ValueError("devices must be distinct and their number a multiple of the group size")
    return [devices[i : i + each] for i in range(0, len(devices), each)]


def stage_end(configured: int | None, rows: int, size: int, most: int | None = None) -> int:
    """The subset to stop before: as configured, else as many as the pool fills."""
    end = configured if configured is not None else math.ceil(rows / size)
    return end if most is None else min(end, most)
