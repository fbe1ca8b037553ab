"""When the next run is due, and a loop that can be stopped."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from datetime import datetime, timedelta


def next_run(now: datetime, minutes: int) -> datetime:
    """Whole hours run at the full hour, every so many hours from now's hour on; other intervals run so many minutes from now."""
    if minutes <= 0:
        raise ValueError("an interval has at least one minute")
    if minutes % 60 == 0:
        return now.replace(minute=0, second=0, microsecond=0) + timedelta(minutes=minutes)
    return now + timedelta(minutes=minutes)


def run_loop(step: Callable[[], object], minutes: int, stop: threading.Event, clock: Callable[[], datetime] = datetime.now) -> int:
    """Run ``step`` at once and then on schedule until ``stop`` is set; an error ends that run only. Returns the number of runs."""
    runs = 0
    while not stop.is_set():
        due = next_run(clock(), minutes)
        try:
            step()
        except Exception as e:  # the next run may succeed
            print(f"run failed: {type(e).__name__}: {e}")
        runs += 1
        stop.wait(max(0.0, (due - clock()).total_seconds()))
    return runs


def stop_on_signals(stop: threading.Event) -> None:
    """Set ``stop`` when the process is asked to end; a run that is under way finishes first."""
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: stop.set())
