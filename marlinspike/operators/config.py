"""Configuration: presets, merging, validation, and the parameters a search may vary.

Driver-side dictionaries; nothing here is data.
"""

from __future__ import annotations

import copy
import hashlib
import json
import re
from dataclasses import dataclass
from typing import Any

import yaml

#: Max hash distance, recall threshold and depth, final threshold, results.
_PRESET_VALUES = {
    "conservative": (3, 0.85, 50, 0.90, 5),
    "balanced": (5, 0.75, 100, 0.85, 10),
    "aggressive": (8, 0.65, 200, 0.75, 20),
}
DEFAULT_TOP_K = 3
TOP_N_RANGE = (1, 20)
HASH_ALGORITHMS = ("dHash", "aHash", "pHash")
INDEX_TYPES = ("Flat", "IVFFlat", "IVFPQ", "HNSW")


def preset(name: str) -> dict:
    if name not in _PRESET_VALUES:
        raise ValueError(f"unknown preset {name}; there are {', '.join(_PRESET_VALUES)}")
    distance, recall, depth, final, top = _PRESET_VALUES[name]
    return {
        "matching": {
            "exact_match": {"enabled": True, "hash_max_distance": distance},
            "content_match": {"enabled": True, "stage1": {"threshold": recall, "top_k": depth}, "final_threshold": final},
            "output": {"top_k": top},
        }
    }


def list_presets() -> list[str]:
    return list(_PRESET_VALUES)


def deep_merge(base: dict, override: dict) -> dict:
    """Nested merge; the later value wins, lists are replaced, None is kept."""
    out = copy.deepcopy(base)
    for key, value in override.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def nested_get(config: dict, path: str, default: Any = None) -> Any:
    """Value at a dotted path; missing and None give the default."""
    for key in path.split("."):
        if not isinstance(config, dict) or config.get(key) is None:
            return default
        config = config[key]
    return config


def nested_set(config: dict, path: str, value: Any) -> dict:
    *parents, last = path.split(".")
    at = config
    for key in parents:
        at = at.setdefault(key, {})
    at[last] = value
    return config


def load_yaml(text: str) -> dict:
    """Mapping of a YAML text; malformed or other content gives an empty one."""
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError:
        return {}
    return found if isinstance(found, dict) else {}


def clamp_top_n(value: int) -> int:
    return max(TOP_N_RANGE[0], min(TOP_N_RANGE[1], int(value)))


def require_top_n(value: int) -> int:
    if not TOP_N_RANGE[0] <= value <= TOP_N_RANGE[1]:
        raise ValueError(f"top_n must be within {TOP_N_RANGE[0]} and {TOP_N_RANGE[1]}")
    return value


def clamp_workers(value: Any, most: int, default: int, least: int = 1) -> int:
    """Whole part of a number within bounds; what is no number gives the default."""
    try:
        return max(least, min(most, int(value)))
    except (TypeError, ValueError):
        return max(least, min(most, default))


def validate_database_name(name: str) -> str:
    if not name or len(name) > 100 or not re.fullmatch(r"[^\W]+(?:[\w-])*|[-_][\w-]*", name):
        raise ValueError("a database name has 1 to 100 letters, digits, - or _")
    return name


def divisors(n: int, most: int = 128, last: int = 6) -> list[int]:
    return [d for d in range(1, min(n, most) + 1) if n % d == 0][-last:]


def validate(config: dict) -> list[str]:
    """Messages on what is wrong; an empty list if all is well."""
    problems = []

    def check(path: str, kind, good, what: str) -> None:
        value = nested_get(config, path)
        if value is not None and (not isinstance(value, kind) or isinstance(value, bool) and kind is not bool or not good(value)):
            problems.append(f"{path}: {what}")

    number = (int, float)
    check("features.perceptual_hash.algorithm", str, HASH_ALGORITHMS.__contains__, f"one of {', '.join(HASH_ALGORITHMS)}")
    check("features.perceptual_hash.hash_size", int, lambda v: 8 <= v <= 32, "8 to 32")
    check("index.type", str, INDEX_TYPES.__contains__, f"one of {', '.join(INDEX_TYPES)}")
    check("matching.content_match.stage1.top_k", int, lambda v: 1 <= v <= 1000, "1 to 1000")
    check("matching.exact_match.hash_max_distance", int, lambda v: v >= 0, "0 or more")
    for path in ("matching.content_match.stage1.threshold", "matching.content_match.final_threshold"):
        check(path, number, lambda v: 0 <= v <= 1, "within 0 and 1")
    kind, dim = nested_get(config, "index.type"), nested_get(config, "index.embedding_dim")
    lists, probe, parts = (nested_get(config, f"index.{k}") for k in ("nlist", "nprobe", "m_pq"))
    if kind in ("IVFFlat", "IVFPQ") and lists and probe and probe > lists:
        problems.append("index.nprobe: at most nlist")
    if kind == "IVFPQ" and parts and dim and dim % parts:
        problems.append(f"index.m_pq: a divisor of embedding_dim, such as {divisors(dim)}")
    if nested_get(config, "matching.visual_match.enabled") and not nested_get(config, "features.deep_features.enabled"):
        problems.append("matching.visual_match: needs features.deep_features")
    return problems


@dataclass(frozen=True)
class ParamSpec:
    path: str
    default: Any
    least: float
    most: float


def param_specs(build: dict) -> list[ParamSpec]:
    """Parameters that a search may vary, given how the index was built."""
    specs, size = [], nested_get(build, "features.perceptual_hash.hash_size")
    if size:
        specs.append(ParamSpec("matching.exact_match.hash_max_distance", min(nested_get(build, "matching.exact_match.hash_max_distance", 5), size * size), 0, size * size))
    specs += [
        ParamSpec("matching.content_match.stage1.threshold", nested_get(build, "matching.content_match.stage1.threshold", 0.75), 0.0, 1.0),
        ParamSpec("matching.content_match.stage1.top_k", nested_get(build, "matching.content_match.stage1.top_k", 100), 1, 1000),
        ParamSpec("matching.content_match.final_threshold", nested_get(build, "matching.content_match.final_threshold", 0.85), 0.0, 1.0),
    ]
    kind = nested_get(build, "index.type", "Flat")
    if kind in ("IVFFlat", "IVFPQ"):
        lists = nested_get(build, "index.nlist", 100)
        specs.append(ParamSpec("index.nprobe", min(nested_get(build, "index.nprobe", 10), lists), 1, lists))
    elif kind == "HNSW":
        specs.append(ParamSpec("index.ef_search", nested_get(build, "index.ef_search", 64), 1, 1024))
    return specs


def search_config(values: dict[str, Any]) -> dict:
    """Nested override of dotted parameters; None is left out."""
    out: dict = {}
    for path, value in values.items():
        if value is not None:
            nested_set(out, path, value)
    return out


def resolve(path: str, *layers: dict, default: Any = None) -> Any:
    """First non-blank value among the layers: snapshot, stored configuration, then the default."""
    for layer in layers:
        if (value := nested_get(layer or {}, path)) not in (None, ""):
            return value
    return default


def index_section(text: str | None) -> dict:
    """The index part of a YAML configuration; an empty one if there is none or it cannot be read."""
    found = load_yaml(text).get("index") if text else None
    return found if isinstance(found, dict) else {}


def config_key(config: dict) -> str:
    """16 hexadecimal digits that depend on the content, not on the order of keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
