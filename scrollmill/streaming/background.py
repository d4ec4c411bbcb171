"""Scans beside a reader: one at a time on a thread of its own, and when a reader should look again."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from scrollmill.plans import ingest
from scrollmill.sources.store import Store

#: Seconds between two looks during a scan, between two scans, and after a key is pressed.
LOOK, RESCAN, SETTLE = 1.0, 3.0, 0.06


@dataclass(frozen=True)
class Snapshot:
    """What a scan has done so far: the chunks it committed, and how it ended."""

    committed_chunks: int = 0
    report: ingest.Report | None = None
    error: str | None = None

    @property
    def finished(self) -> bool:
        return self.report is not None or self.error is not None


class Scan:
    """One scan of `roots` into `store` on a thread; left by `with`, it is stopped and waited for."""

    def __init__(self, store: Store, roots: dict[int, list[str]], scan: Callable[..., ingest.Report] = ingest.ingest) -> None:
        self._stop = threading.Event()
        self._lock = threading.Lock()
        self._state = Snapshot()
        self._thread = threading.Thread(target=self._run, args=(store, roots, scan), name="scan", daemon=True)
        self._thread.start()

    def _run(self, store: Store, roots: dict[int, list[str]], scan: Callable[..., ingest.Report]) -> None:
        try:
            report = scan(store, roots, stop=self._stop.is_set)
            done = Snapshot(0 if report.stopped else report.chunks, report)
        except Exception as e:  # a scan that fails must not take its readers down
            done = Snapshot(error=f"{type(e).__name__}: {e}")
        with self._lock:
            self._state = done

    def snapshot(self) -> Snapshot:
        with self._lock:
            return replace(self._state)

    def request_stop(self) -> None:
        """Ask the scan to stop, without waiting; what is not committed by then is left."""
        self._stop.set()

    def stop(self) -> Snapshot:
        """Ask the scan to stop, wait for it, and tell how it ended."""
        self.request_stop()
        self._thread.join()
        return self.snapshot()

    def __enter__(self) -> Scan:
        return self

    def __exit__(self, *_) -> None:
        self.stop()


class Cadence:
    """When to search again and when to scan again; `clock` tells the time in seconds."""

    def __init__(self, clock: Callable[[], float] = time.monotonic) -> None:
        self.clock = clock
        self.looked = self.scanned = self.pressed = float("-inf")
        self.dirty = False

    def press(self) -> None:
        """A key was pressed: the query is searched once the keys have settled."""
        self.pressed, self.dirty = self.clock(), True

    def should_look(self, scanning: bool, grown: bool) -> bool:
        """Whether to search now: keys have settled, or a scan has committed more and the last look is old enough."""
        now = self.clock()
        due = self.dirty and now - self.pressed >= SETTLE or not self.dirty and scanning and grown and now - self.looked >= LOOK
        if due:
            self.looked, self.dirty = now, False
        return due

    def should_scan(self, scanning: bool) -> bool:
        """Whether to start another scan: none runs and the last one began long enough ago."""
        now = self.clock()
        due = not scanning and now - self.scanned >= RESCAN
        if due:
            self.scanned = now
        return due
