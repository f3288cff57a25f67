"""The lifecycle tasks: run by name, or by a scheduler when they are due; history and counters."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Mapping

from ..errors import ConflictError, NotFoundError
from .store import MemoryStore, _lifecycle_tasks

HOUR_S = 3600.0
#: Seconds between the runs of a task.
INTERVALS = {
    "expire_short_term": HOUR_S / 12,
    "importance_decay": 24 * HOUR_S,
    "active_forgetting": 24 * HOUR_S,
    "consolidate_similar": 24 * HOUR_S,
    "cleanup_archived": 24 * HOUR_S,
    "discover_connections": 6 * HOUR_S,
    "stats": HOUR_S,
}


class TaskRegistry:
    """Run, pause, resume, history. A task does not run twice at a time."""

    def __init__(self, store: MemoryStore, history: Iterable[dict] = (), most: int = 1000):
        self.store, self.paused, self.running = store, set(), set()
        self.history: deque[dict] = deque(history, most)
        self.tasks = _lifecycle_tasks(store)
        self.totals: dict[str, dict[str, int]] = {name: {"runs": 0, "failures": 0, "skipped": 0} for name in self.tasks}
        self._lock = threading.Lock()

    def run(self, name: str, now_ms: int) -> dict:
        """One run's entry: its status, what it counted, -1 affected rows when it failed."""
        self._known(name)
        with self._lock:
            if name in self.running:
                raise ConflictError(f"{name} is running")
            self.running.add(name)
        entry = {"task": name, "started_at": now_ms, "finished_at": now_ms, "status": "skipped", "affected": 0, "error": None, "counters": {}}
        began = time.monotonic()
        try:
            if name not in self.paused:
                counters = self.tasks[name](now_ms)
                entry |= {"status": "ok", "affected": int(counters["affected"]), "counters": counters}
        except Exception as e:
            entry |= {"status": "failed", "affected": -1, "error": str(e)[:500]}
        finally:
            self.running.discard(name)
        entry["finished_at"] = now_ms + int((time.monotonic() - began) * 1000)
        with self._lock:
            total = self.totals[name]
            total[{"ok": "runs", "failed": "failures", "skipped": "skipped"}[entry["status"]]] += 1
            for key, n in entry["counters"].items():
                total[key] = total.get(key, 0) + n
            self.history.append(entry)
        return entry

    def _known(self, name: str) -> None:
        if name not in self.tasks:
            raise NotFoundError(f"no task {name}")

    def pause(self, name: str) -> None:
        self._known(name)
        self.paused.add(name)

    def resume(self, name: str) -> None:
        self._known(name)
        self.paused.discard(name)

    def status(self) -> list[dict]:
        """Each task with what it counted so far and its last run."""
        last = {e["task"]: e for e in self.history}
        return [{"task": n, "paused": n in self.paused, "running": n in self.running, "totals": dict(self.totals[n]), "last": last.get(n)} for n in self.tasks]


class Scheduler:
    """Runs tasks when they are due. `tick` does so once for a given time; `start` ticks in a thread of its own.

    `jobs` are functions of the time besides the registry's tasks, such as flushes, compactions and checkpoints.
    """

    def __init__(self, registry: TaskRegistry, intervals: Mapping[str, float] | None = None, jobs: Mapping[str, tuple[float, Callable[[int], object]]] | None = None):
        self.registry, self.jobs = registry, dict(jobs or {})
        self.intervals = {**INTERVALS, **(intervals or {}), **{name: every for name, (every, _) in self.jobs.items()}}
        self.last: dict[str, int] = {}
        self.failures: dict[str, str] = {}
        self._stop, self._thread = threading.Event(), None

    def due(self, now_ms: int) -> list[str]:
        """Tasks whose time has come; one that never ran waits for one interval from the first tick."""
        for name in self.intervals:
            self.last.setdefault(name, now_ms)
        return [n for n, every in self.intervals.items() if now_ms - self.last[n] >= every * 1000]

    def tick(self, now_ms: int) -> list[str]:
        ran = []
        for name in self.due(now_ms):
            self.last[name] = now_ms
            try:
                self.jobs[name][1](now_ms) if name in self.jobs else self.registry.run(name, now_ms)
                ran.append(name)
            except ConflictError:
                continue  # it is running already; the next tick after its interval tries again
            except Exception as e:  # a job's failure must not end the others
                self.failures[name] = str(e)[:500]
        return ran

    def start(self, every_s: float = 1.0, clock: Callable[[], float] = time.time) -> None:
        def work():
            while not self._stop.wait(every_s):
                self.tick(int(clock() * 1000))

        self._stop.clear()
        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        """End after the tick that is under way."""
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
