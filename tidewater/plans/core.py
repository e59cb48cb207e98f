"""Model registry and the per-session warehouse context.

A model is a Python function ``(warehouse) -> DataFrame``; models call
``w.ref(name)`` for upstream models and ``w.raw(name)`` for landed tables.
DataFrames are lazy, so a report is one Catalyst plan over the raw scans
unless an upstream model is listed in ``materialize`` (the "table" layers),
in which case it is written once as Parquet under the warehouse folder and
read back: later reports start from it and the lineage is cut (a lost
executor recomputes from that table, not from the raw scan).

``build(names, threads)`` materialises independent models concurrently:
Spark runs jobs submitted from separate threads side by side, so small
jobs of independent branches share the cores instead of queueing.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

MODELS: dict[str, Callable[["Warehouse"], DataFrame]] = {}
LAYERS: dict[str, str] = {}


def model(name: str, layer: str = "view"):
    """Register a model function under ``name``."""

    def deco(fn):
        MODELS[name] = fn
        LAYERS[name] = layer
        return fn

    return deco


class Warehouse:
    def __init__(
        self,
        spark: SparkSession,
        raw: Callable[[str], DataFrame],
        materialize: Iterable[str] = (),
        partition_by: dict[str, list[str]] | None = None,
    ):
        self.spark = spark
        self.raw = raw
        self.materialize = set(materialize)
        self.partition_by = partition_by or {}
        self._cache: dict[str, DataFrame] = {}
        self._errors: dict[str, BaseException] = {}
        self._pending: dict[str, threading.Event] = {}
        self._lock = threading.Lock()
        self.timings: dict[str, tuple[float, float]] = {}  # name -> (start, end) wall clock

    def ref(self, name: str) -> DataFrame:
        """The model's DataFrame; built (and materialised) once per warehouse."""
        with self._lock:
            if name in self._cache:
                return self._cache[name]
            if name in self._errors:
                raise self._errors[name]
            event = self._pending.get(name)
            owner = event is None
            if owner:
                event = self._pending[name] = threading.Event()
        if not owner:
            event.wait()
            with self._lock:
                if name in self._errors:
                    raise self._errors[name]
                return self._cache[name]
        start = time.time()
        try:
            df = MODELS[name](self)
            if name in self.materialize:
                from tidewater.sources.sinks import materialize_table

                df = materialize_table(self.spark, df, name, self.partition_by.get(name))
            with self._lock:
                self._cache[name] = df
                self.timings[name] = (start, time.time())
            return df
        except BaseException as e:
            with self._lock:
                self._errors[name] = e
            raise
        finally:
            event.set()

    def build(self, names: Iterable[str], threads: int = 1) -> None:
        """Build ``names`` (and their upstream models) with ``threads`` workers."""
        names = list(names)
        if threads <= 1:
            for n in names:
                self.ref(n)
            return
        with ThreadPoolExecutor(max_workers=threads) as pool:
            for f in [pool.submit(self.ref, n) for n in names]:
                f.result()
