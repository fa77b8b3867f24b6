"""A scan's state on the driver: one run at a time, progress, the last error, and a stop between its steps."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from typing import Any


class Scan:
    """Runs steps (source name, function) in the background; what a step returns goes to ``on_rows``.

    A step that fails leaves its message as the error and the rest goes on; a later error replaces an earlier one.
    """

    def __init__(self, on_rows: Callable[[str, Any], None] = lambda *_: None, on_status: Callable[[dict], None] = lambda _: None, on_done: Callable[[dict], None] = lambda _: None):
        self._lock, self._stop = threading.Lock(), threading.Event()
        self._on_rows, self._on_status, self._on_done = on_rows, on_status, on_done
        self._thread: threading.Thread | None = None
        self._state: dict[str, Any] = {"running": False, "done": 0, "total": 0, "percent": 0, "error": ""}

    def status(self) -> dict:
        with self._lock:
            return dict(self._state)

    def start(self, steps: Iterable[tuple[str, Callable[[], Any]]]) -> bool:
        """False, and nothing else, where a run is on."""
        todo = list(steps)
        with self._lock:
            if self._state["running"]:
                return False
            self._state = {"running": True, "done": 0, "total": len(todo), "percent": 0, "error": ""}
            self._stop.clear()
            self._thread = threading.Thread(target=self._run, args=(todo,), daemon=True)
        self._thread.start()
        return True

    def cancel(self) -> None:
        self._stop.set()

    def join(self, seconds: float | None = None) -> dict:
        if self._thread is not None:
            self._thread.join(seconds)
        return self.status()

    def _run(self, todo: list) -> None:
        for name, step in todo:
            if self._stop.is_set():
                break
            error = None
            try:
                self._on_rows(name, step())
            except Exception as e:  # one source's failure is the run's message, not its end
                error = f"{name}: {e}"
            with self._lock:
                s = self._state
                s["done"] += 1
                s["percent"] = s["done"] * 100 // s["total"]
                s["error"] = error or s["error"]
            self._on_status(self.status())
        with self._lock:
            self._state["running"] = False
            if not self._stop.is_set():
                self._state["percent"] = 100
        self._on_done(self.status())
