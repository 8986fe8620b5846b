"""Configuration: reading, merging, profiles and strict checks. It is small and stays on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import SparkSession

from vocalis.sources import files


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON or YAML mapping from any path that Spark reads; an empty file is an empty mapping."""
    text = files.read_text(spark, path)
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path} needs a YAML parser; JSON needs none") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text) if text.strip() else None
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def merged(*layers: dict[str, Any]) -> dict[str, Any]:
    """Mappings over one another, the later wins; mappings inside merge too, everything else is replaced as a whole."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            both = isinstance(value, dict) and isinstance(out.get(key), dict)
            out[key] = merged(out[key], value) if both else value
    return out


def profiled(config: dict[str, Any], name: str) -> dict[str, Any]:
    """The configuration under its profile of that name, which may override any subtree; an unknown or empty profile changes nothing."""
    chosen = {k: v for k, v in (config.get("profiles", {}).get(name) or {}).items() if k != "description"}
    return merged(config, chosen)


def overridden(config: dict[str, Any], values: dict[str, Any]) -> dict[str, Any]:
    """Values by dotted path, as a command line gives them."""
    for path, value in values.items():
        layer: Any = value
        for key in reversed(path.split(".")):
            layer = {key: layer}
        config = merged(config, layer)
    return config


def problems(config: dict[str, Any], schema: dict[str, type | tuple[type, ...]], required: Iterable[str] = ()) -> list[str]:
    """What a strict check finds: keys that the schema (by dotted path) doesn't know, values of another type, missing keys."""
    found: list[str] = []
    seen: set[str] = set()

    def walk(node: dict[str, Any], at: str) -> None:
        for key, value in node.items():
            path = f"{at}{key}"
            seen.add(path)
            if path in schema:
                kinds = schema[path] if isinstance(schema[path], tuple) else (schema[path],)
                if not isinstance(value, kinds) or isinstance(value, bool) and bool not in kinds:
                    found.append(f"{path}: {type(value).__name__} isn't {' or '.join(k.__name__ for k in kinds)}")
            elif isinstance(value, dict) and any(p.startswith(f"{path}.") for p in schema):
                walk(value, f"{path}.")
            else:
                found.append(f"{path}: unknown")

    walk(config, "")
    return found + [f"{path}: missing" for path in required if path not in seen]


def checked(config: dict[str, Any], schema: dict[str, type | tuple[type, ...]], required: Iterable[str] = ()) -> dict[str, Any]:
    if found := problems(config, schema, required):
        raise ValueError("; ".join(found))
    return config


def stages(text: str | None, known: Iterable[str]) -> list[str] | None:
    """A list of stage names, separated by commas, in any case; none means all. An unknown name raises."""
    named = [part.strip().lower() for part in (text or "").split(",") if part.strip()]
    if wrong := [n for n in named if n not in set(known)]:
        raise ValueError(f"unknown stage: {', '.join(wrong)}")
    return named or None
