"""Settings of a scoring application, from Spark settings or the environment."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

from .params import SearchParams


def bounded_int(text: str | None, default: int, low: int, high: int) -> int:
    """The whole number that ``text`` begins with (0 if none), kept within the
    bounds; ``default`` where there is no text."""
    if text is None:
        return default
    m = re.match(r"\s*([+-]?[0-9]+)", text)
    return min(high, max(low, int(m[1]) if m else 0))


@dataclass(frozen=True)
class Settings:
    index_path: str = "resources/index"
    nprobe: int = 10
    candidates: int = 0

    def params(self) -> SearchParams:
        return replace(SearchParams(), nprobe=self.nprobe)


#: Least and largest value of each number (fixed values).
BOUNDS = {"nprobe": (1, 64), "candidates": (0, 2_000_000)}


def load_settings(spark: SparkSession | None = None, env: Mapping[str, str] = os.environ) -> Settings:
    """``spark.tessera.<name>`` if set, else ``TESSERA_<NAME>``, else the default."""
    found = {}
    for f in fields(Settings):
        own = spark.conf.get(f"spark.tessera.{f.name}", None) if spark else None
        own = env.get(f"TESSERA_{f.name.upper()}") if own is None else own
        found[f.name] = bounded_int(own, f.default, *BOUNDS[f.name]) if f.name in BOUNDS else (own or f.default)
    return Settings(**found)
