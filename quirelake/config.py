"""Settings as plain data, from nested dictionaries or JSON files; ``${NAME}`` and ``${NAME:default}`` take environment values."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    name: str
    enabled: bool = True
    concurrent: bool = True
    priority: int = 10
    timeout: float = 30.0
    attempts: int = 3


@dataclass(frozen=True)
class GraphConfig:
    top_papers: int = 20
    top_clusters: int = 10
    cocitation_threshold: int = 2
    recency_windows: tuple[int, ...] = (2, 5)
    core: int = 50
    largest_component_only: bool = True
    compute_betweenness: bool = False
    clustering: str = "authority"
    damping: float = 0.85
    rounds: int = 30
    seed: int = 0


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...] = ()
    merge: str = "union"
    fallback: tuple[str, ...] = ()
    graph: GraphConfig = field(default_factory=GraphConfig)
    contradiction_threshold: float = 0.05
    coverage_threshold: float = 0.85
    verify_limit: int | None = None
    batch_size: int = 10
    weights: dict[str, float] = field(default_factory=dict)
    debate_rounds: int = 3

    def source_table(self, spark: SparkSession) -> DataFrame:
        """(source, enabled, concurrent, priority)."""
        return spark.createDataFrame([(s.name, s.enabled, s.concurrent, s.priority) for s in self.sources], "source string, enabled boolean, concurrent boolean, priority int")

    def weight_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.weights.items()), "sub_id string, weight double")


def expanded(value: Any) -> Any:
    """Environment values put in, at every depth; an unset name without a default becomes empty."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), value)
    if isinstance(value, dict):
        return {k: expanded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v) for v in value]
    return value


def _made(kind, values: dict):
    known = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def from_dict(values: dict) -> Config:
    """Sources may be a list of settings, or, the older layout, a map of names to settings or to true and false."""
    values = expanded(values)
    listed = values.get("sources") or []
    if isinstance(listed, dict):
        listed = [{"name": k, **(v if isinstance(v, dict) else {"enabled": bool(v)})} for k, v in listed.items()]
    sources = tuple(_made(Source, s) for s in listed)
    graph = _made(GraphConfig, values.get("graph") or {})
    rest = {k: v for k, v in values.items() if k not in ("sources", "graph")}
    return _made(Config, {**rest, "sources": sources, "graph": graph})


def load(path: str | None = None) -> Config:
    if path is None:
        return Config()
    with open(path) as f:
        return from_dict(json.load(f))
