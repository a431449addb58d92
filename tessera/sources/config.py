"""Configuration on the driver: nested TOML with inheritance, JSON with comment lines, dotted overrides."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path


def merged(base: dict, over: dict) -> dict:
    """``over`` on ``base``; tables merge, all else replaces."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def manifest(path: str, required: tuple[str, ...] = ()) -> dict:
    """A TOML manifest on top of the one that its ``extends`` names; a required key that is missing is an error."""
    own = tomllib.loads(Path(path).read_text())
    base = own.pop("extends", None)
    whole = merged(manifest(str(Path(path).parent / base)), own) if base else own
    missing = [k for k in required if k not in whole]
    if missing:
        raise KeyError(f"{path} lacks {', '.join(missing)}")
    return whole


def commented_json(path: str) -> dict:
    """JSON whose lines may be ``//`` comments; the text ``none`` in any case is None."""
    lines = [x for x in Path(path).read_text().splitlines() if not x.lstrip().startswith("//")]
    return without_none(json.loads("\n".join(lines)))


def without_none(x):
    if isinstance(x, dict):
        return {k: without_none(v) for k, v in x.items()}
    if isinstance(x, list):
        return [without_none(v) for v in x]
    return None if isinstance(x, str) and x.lower() == "none" else x


def overridden(config: dict, overrides: list[str]) -> tuple[dict, list[str]]:
    """(config, unknown) after ``a.b.c=value`` texts; values stay text and unknown leaves are passed over."""
    out, unknown = merged({}, config), []
    for text in overrides:
        key, _, value = text.partition("=")
        *path, leaf = key.split(".")
        at = out
        for p in path:
            at = at.get(p) if isinstance(at, dict) else None
        if not isinstance(at, dict) or leaf not in at:
            unknown.append(key)
        else:
            at[leaf] = value
    return out, unknown


def audit(stated: dict, read: set[str], prefix: str = "") -> list[str]:
    """Dotted keys that are stated and that nothing reads."""
    out = []
    for k, v in stated.items():
        name = f"{prefix}{k}"
        out += audit(v, read, f"{name}.") if isinstance(v, dict) else [] if name in read else [name]
    return sorted(out)
