"""Progress of a batch job: counters that grow as tasks end, reported every so many pairs."""

from __future__ import annotations

import sys
import threading
import time
from collections import Counter
from typing import TextIO

from pyspark import Accumulator, SparkContext
from pyspark.accumulators import AccumulatorParam

from ..operators.kernel import MERGED, MISMATCH, NO_OVERLAP, REJECTED


class _Counters(AccumulatorParam):
    def zero(self, value: Counter) -> Counter:
        return Counter()

    def addInPlace(self, value1: Counter, value2: Counter) -> Counter:
        value1.update(value2)
        return value1


def message(seen: Counter, seconds: float) -> str:
    """One line about the pairs seen so far, by status."""
    none, bad, merged = seen[NO_OVERLAP], seen[REJECTED], seen[MERGED]
    processed, pairs = merged + none + bad, sum(seen.values())
    top = "none" if not none + bad else f"{NO_OVERLAP}:{none}" if none >= bad else f"{REJECTED}:{bad}"
    share, rate = merged / processed * 100 if processed else 0.0, pairs / seconds if seconds > 1e-9 else 0.0
    return (
        f"pairs={pairs} merged={merged} unmerged={none + bad} ({share:.1f}% merged) "
        f"mate_mismatches={seen[MISMATCH]} {rate:.0f} pairs/s top_unmerged={top}"
    )


class Progress:
    """Reports while in use as a context: a line for each ``every`` pairs passed (0: none).

    ``mode`` is ``plain`` (a line each), ``live`` (one line, rewritten) or ``off``.  Counters come as
    tasks end, and count a task twice that had to be repeated.
    """

    def __init__(self, context: SparkContext, every: int, mode: str = "plain", out: TextIO | None = None, pause: float = 0.5):
        if mode not in ("plain", "live", "off") or every < 0:
            raise ValueError("mode must be plain, live or off, and every not negative")
        self.seen: Accumulator = context.accumulator(Counter(), _Counters())
        self.every, self.mode, self.out, self.pause = every, mode, out or sys.stderr, pause
        self.next, self.began, self._ended = every, time.monotonic(), threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    @property
    def active(self) -> bool:
        return self.mode != "off" and self.every > 0

    def maybe_report(self) -> bool:
        """Report if the next threshold is passed; thresholds passed meanwhile are one report."""
        seen = Counter(self.seen.value)
        pairs = sum(seen.values())
        if not self.active or pairs < self.next:
            return False
        self.next = (pairs // self.every + 1) * self.every
        text = message(seen, time.monotonic() - self.began)
        self.out.write(f"\r{text}" if self.mode == "live" else f"{text}\n")
        self.out.flush()
        return True

    def _watch(self) -> None:
        while not self._ended.wait(self.pause):
            self.maybe_report()

    def __enter__(self) -> Progress:
        if self.active:
            self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._ended.set()
        if self.active:
            self._thread.join()
            self.maybe_report()
            if self.mode == "live":
                self.out.write("\r\033[K")
