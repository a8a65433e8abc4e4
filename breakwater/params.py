"""Calling parameters, with the defaults that take effect."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Params:
    min_mapq: int = 30
    min_sv_size: int = 50
    min_del_size: int = 15
    min_support: dict[str, int] = field(default_factory=lambda: {"INS": 4, "DEL": 1, "DUP": 10, "INV": 3, "BND": 1, "CPX": 3})
    min_af: dict[str, float] = field(default_factory=lambda: {"BND": 0.03, "DEL": 0.015, "INS": 0.25, "DUP": 0.40, "INV": 0.15, "CPX": 0.15})
    repeat_modifier: dict[str, float] = field(default_factory=lambda: {"DEL": 1.0, "INS": 0.4, "INV": 2.0, "CPX": 0.2})
    dup_depth_threshold: float = 3.8
    dup_min_af: float = 0.40
    complex_reads: int = 14
    complex_distance: int = 1000
    merge_distance: int = 1000
    ploidy: int = 2
    coverage: float = 30.0
    # Fixed values of the method: largest distance of neighbours in a cluster, by type.
    chain_distance: dict[str, int] = field(default_factory=lambda: {"BND": 900, "DEL": 1000, "DUP": 250, "INS": 250, "CPX": 70, "INV": 200})


def from_json(text: str, **values: object) -> tuple[Params, list[str]]:
    """Params from a JSON object or the inside of one, with ${NAME} replaced by values; and the keys that have no effect."""
    for name, value in values.items():
        text = text.replace("${" + name + "}", str(value))
    body = text.strip()
    given = json.loads(body if body.startswith("{") else "{" + re.sub(r",\s*$", "", body) + "}")
    base, known, unused = Params(), {f.name for f in fields(Params)}, []
    named = {"min_support_complex": "complex_reads", "complex_max_distance": "complex_distance", "complex_merge_distance": "merge_distance", "dup_min_af_split": "dup_min_af", "expected_coverage": "coverage"}
    maps = {"min_support": dict(base.min_support), "min_af": dict(base.min_af), "repeat_modifier": dict(base.repeat_modifier)}
    plain: dict[str, object] = {}
    for key, value in given.items():
        short = key.replace("repeat_support_modifier_", "repeat_modifier_")
        table = next((m for m in maps if short.startswith(m + "_") and short[len(m) + 1 :].upper() in maps[m]), None)
        if key in named:
            plain[named[key]] = value
        elif table:
            maps[table][short[len(table) + 1 :].upper()] = value
        elif key in known and key not in maps:
            plain[key] = value
        else:
            unused.append(key)
    return replace(base, **maps, **plain), unused
