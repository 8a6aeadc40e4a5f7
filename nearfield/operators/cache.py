"""Cached index tables, by index and version, within a budget.

An entry is a persisted DataFrame; the least recently used ones go when a new
one wouldn't fit. A cache never decides a result: what isn't cached is read.
"""

from __future__ import annotations

import itertools
import threading
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SLOTS = 64
_lock = threading.RLock()
_entries: OrderedDict[str, Entry] = OrderedDict()
_generation, _clock = itertools.count(1), itertools.count(1)
_budget = 512 << 20


@dataclass
class Entry:
    name: str
    version: int
    frame: DataFrame
    held: DataFrame
    nelems: int
    bytes: int
    generation: int
    lastused: int
    state: str = "READY"  # or PARTIAL: as many shards as fit
    codes: bool = False
    busy: int = 0


def shards(index, options) -> DataFrame:
    """The index's shards, from the cache as far as they fit into it."""
    global _budget
    with _lock:
        _budget = options.cache_mb << 20
        found = _entries.get(index.name)
        codes = options.use_codes and not index.options.inline_codes
        if found and found.version == index.version and found.codes >= codes:
            found.lastused = next(_clock)
            _entries.move_to_end(index.name)
            return found.frame
        rows, dim, number = index.manifest["rows"], index.manifest["dim"] or 0, index.manifest["shards"]
        source = index.coded if codes else index.shards
        need = rows * ((9 if codes else 8) * dim + 4 * (index.options.degree + index.options.payload_degree) + 64)
        part = number if need <= _budget else number * _budget // need
        if not part:
            return index.shards
        invalidate(index.name)
        need = need * part // number
        while _entries and (sum(e.bytes for e in _entries.values()) + need > _budget or len(_entries) >= SLOTS):
            idle = next((e for e in _entries.values() if not e.busy), None)
            if idle is None:
                return index.shards
            evict(idle.name)
        held = (source if part == number else source.where(f"shard < {part}")).persist()
        frame = held if part == number else held.unionAll(source.where(f"shard >= {part}"))
        _entries[index.name] = Entry(index.name, index.version, frame, held, rows * part // number, need, next(_generation), next(_clock), "READY" if part == number else "PARTIAL", codes)
        return frame


def invalidate(name: str) -> None:
    with _lock:
        if (e := _entries.pop(name, None)) is not None:
            e.held.unpersist()


def evict(name: str) -> bool:
    """False if there is no such entry or it is in use."""
    with _lock:
        if name not in _entries or _entries[name].busy:
            return False
        invalidate(name)
        return True


def reset() -> int:
    """Evict all idle entries; how many."""
    with _lock:
        return sum(evict(name) for name in list(_entries))


class pinned:
    """Keeps an entry while a block runs."""

    def __init__(self, name: str):
        self.name = name

    def __enter__(self):
        with _lock:
            if self.name in _entries:
                _entries[self.name].busy += 1

    def __exit__(self, *_):
        with _lock:
            if self.name in _entries:
                _entries[self.name].busy -= 1


def stats(spark: SparkSession) -> DataFrame:
    with _lock:
        rows = [(e.name, e.version, e.state, e.nelems, e.bytes, e.generation, e.lastused) for e in _entries.values()]
    return spark.createDataFrame(rows, "index string, version long, state string, nelems long, bytes long, generation long, lastused long")


def summary(spark: SparkSession) -> DataFrame:
    with _lock:
        row = (sum(e.bytes for e in _entries.values()), _budget, SLOTS, len(_entries))
    return spark.createDataFrame([row], "total_bytes long, budget_bytes long, n_slots int, n_occupied int")
