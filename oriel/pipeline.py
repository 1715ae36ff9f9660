"""Migration phases in order, with weights, progress and cancellation."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: Share of the whole that each phase is taken for.
WEIGHTS = {"EXTRACT": 0.15, "PARSE": 0.10, "EXPORT": 0.15, "EXECUTE_PRE": 0.05, "TRANSFER": 0.50, "EXECUTE_POST": 0.05}


class Busy(RuntimeError):
    """A job runs already."""


class Cancelled(RuntimeError):
    """The job was asked to end."""


@dataclass
class Migration:
    """Functions by phase; each gets the shared context.  One run at a time."""

    phases: dict[str, Callable[[dict[str, Any]], None]]
    context: dict[str, Any] = field(default_factory=dict)
    done: list[str] = field(default_factory=list)
    state: str = "IDLE"
    error: str = ""
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _stop: threading.Event = field(default_factory=threading.Event)

    def __post_init__(self) -> None:
        unknown = set(self.phases) - set(WEIGHTS)
        if unknown:
            raise ValueError(f"no phase {', '.join(sorted(unknown))}")

    @property
    def percent(self) -> float:
        total = sum(WEIGHTS[p] for p in self.phases)
        return round(100 * sum(WEIGHTS[p] for p in self.done) / total, 6) if total else 100.0

    def cancel(self) -> None:
        self._stop.set()

    def run(self, *only: str) -> dict[str, Any]:
        """All phases, or those named, in their order; cancellation is heeded between phases."""
        if not self._lock.acquire(blocking=False):
            raise Busy("a migration runs already")
        self._stop.clear() if self.state != "CANCELLED" else None
        self.done, self.error, self.state = [], "", "RUNNING"
        try:
            for name in WEIGHTS:
                if name in self.phases and (not only or name in only):
                    if self._stop.is_set():
                        raise Cancelled(name)
                    self.phases[name](self.context)
                    self.done.append(name)
            self.state = "DONE"
        except Cancelled:
            self.state = "CANCELLED"
        except Exception as e:
            self.state, self.error = "FAILED", f"{type(e).__name__}: {e}"
            raise
        finally:
            self._lock.release()
        return self.context
