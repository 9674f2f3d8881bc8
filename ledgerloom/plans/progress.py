"""Progress of a running batch: pages done, pages in all, and the file last heard of."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import SparkSession


class _Counted(AccumulatorParam):
    """(pages, file): a number and one name, so what tasks send doesn't grow with their pages."""

    def zero(self, value: tuple[int, str]) -> tuple[int, str]:
        return 0, ""

    def addInPlace(self, value1: tuple[int, str], value2: tuple[int, str]) -> tuple[int, str]:  # noqa: N802
        return value1[0] + value2[0], value2[1] or value1[1]


class Feed:
    """Calls ``notify(done, total, file)`` whenever tasks have reported more pages, while the block runs.

    Tasks report when they end.  It is a display and no result: pages of a task that was
    run again count twice, but ``done`` never exceeds ``total``.  Nothing is called twice
    with the same numbers; of no pages nothing is said.
    """

    def __init__(self, spark: SparkSession, total: int, notify: Callable[[int, int, str], None], seconds: float = 0.5) -> None:
        self.pages = spark.sparkContext.accumulator((0, ""), _Counted())
        self._total, self._notify, self._seconds = total, notify, seconds
        self._told = 0
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def _tell(self) -> None:
        done, file = self.pages.value
        done = min(done, self._total)
        if done > self._told:
            self._told = done
            self._notify(done, self._total, file)

    def _watch(self) -> None:
        while not self._over.wait(self._seconds):
            self._tell()

    def __enter__(self) -> Feed:
        self._thread.start()
        return self

    def __exit__(self, *failure: object) -> None:
        self._over.set()
        self._thread.join()
        if failure[0] is None:
            self._tell()
