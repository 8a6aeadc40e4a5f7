"""Index options and search settings, with their ranges."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

MAX_DEGREE, MAX_LEVEL, MAX_LAYER0 = 100, 6, 200


def _range(name: str, value, low, high) -> None:
    if isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value!r}")


@dataclass(frozen=True)
class IndexOptions:
    """How a graph is built."""

    m: int = 16
    ef_construction: int = 64
    gamma: int = 1
    payload_edges: bool = False
    payload_m: int = 0
    payload_min_cardinality: int = 0
    diversify: bool = False
    inline_codes: bool = False
    metric: str = "l2"
    build_seed: int = -1
    shard_rows: int = 50_000
    build_mb: int = 0  # memory for one shard's build, 0 for no bound; smaller shards are built if needed

    def __post_init__(self):
        for name, low, high in (("m", 2, 100), ("ef_construction", 4, 1000), ("gamma", 1, 8), ("payload_m", 0, 200), ("payload_min_cardinality", 0, 1_000_000), ("build_seed", -1, 2**31 - 1), ("shard_rows", 1, 10_000_000), ("build_mb", 0, 1 << 20)):
            _range(name, getattr(self, name), low, high)
        if self.m * self.gamma > MAX_DEGREE:
            warnings.warn(f"m * gamma = {self.m * self.gamma} is above {MAX_DEGREE}; {MAX_DEGREE} is used", stacklevel=3)

    @property
    def degree(self) -> int:
        """Neighbours of a node in the upper layers."""
        return min(self.m * self.gamma, MAX_DEGREE)

    @property
    def payload_degree(self) -> int:
        """Further neighbours in layer 0: of the same filter value with
        payload edges, else any."""
        return min(self.payload_m or self.degree, MAX_LAYER0 - self.degree)

    def bytes_per_row(self, dim: int) -> int:
        """What a row takes while a graph is built: its vector and, as Python
        numbers, its links."""
        return 8 * dim + 40 * (self.degree + self.payload_degree) + 500

    as_dict = asdict


@dataclass(frozen=True)
class SearchOptions:
    """How a graph is searched. From a session's conf, keys nearfield.*."""

    ef_search: int = 40
    target_recall: float = 0.0
    member_first: bool = False
    buffered_emission: bool = True
    use_codes: bool = False
    use_cache: bool = True
    enable_index: bool = True
    default_gamma: int = 1
    cache_mb: int = 512

    def __post_init__(self):
        _range("ef_search", self.ef_search, 1, 10_000_000)
        _range("target_recall", self.target_recall, 0, 0.9999)
        _range("default_gamma", self.default_gamma, 1, 8)
        _range("cache_mb", self.cache_mb, 0, 1 << 20)

    @classmethod
    def of(cls, spark: SparkSession, **given) -> SearchOptions:
        kinds = {"ef_search": int, "target_recall": float, "default_gamma": int, "cache_mb": int}
        for name, default in asdict(cls()).items():
            if name not in given and (text := spark.conf.get(f"nearfield.{name}", None)) is not None:
                given[name] = kinds[name](text) if name in kinds else text.lower() in ("1", "on", "true") if isinstance(default, bool) else text
        return cls(**given)
