"""What a run reports while it goes: counters taken along by the plan itself, and a line of progress now and then."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FIRST, EVERY = 1.0, 60.0


def observed(chunks: DataFrame, name: str = "chunks") -> tuple[DataFrame, Observation]:
    """chunks, and an observation that has n_chunks and chunk_bytes once an action has run over them: no pass of its own."""
    seen = Observation(name)
    return chunks.observe(seen, F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("chunksize"), F.lit(0)).alias("chunk_bytes")), seen


class Reporter:
    """Says how many tasks are done, a second after the start and then every `every` seconds; 0 turns it off."""

    def __init__(self, spark: SparkSession, every: float = EVERY, say: Callable[[str], None] = print, first: float = FIRST):
        self.tracker, self.every, self.say, self.first = spark.sparkContext.statusTracker(), every, say, first
        self.over = threading.Event()
        self.thread: threading.Thread | None = None

    def line(self, began: float) -> str:
        stages = [s for i in self.tracker.getActiveStageIds() if (s := self.tracker.getStageInfo(i))]
        done, tasks = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
        return f"{time.time() - began:.0f} s: {len(stages)} stages, {done} of {tasks} tasks"

    def _run(self) -> None:
        began, wait = time.time(), self.first
        while not self.over.wait(wait):
            self.say(self.line(began))
            wait = self.every

    def __enter__(self) -> Reporter:
        if self.every > 0:
            self.thread = threading.Thread(target=self._run, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        if self.thread:
            self.thread.join()
