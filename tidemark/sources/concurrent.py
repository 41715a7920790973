"""Independent Spark actions, submitted at the same time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

T = TypeVar("T")


def together(calls: dict[str, Callable[[], T]]) -> dict[str, T]:
    """Results by name.  Jobs of one call use executors that others leave idle.

    Waits for all calls; the first error is then raised.
    """
    with ThreadPoolExecutor(max_workers=max(1, len(calls))) as pool:
        running = {name: pool.submit(call) for name, call in calls.items()}
    return {name: done.result() for name, done in running.items()}
