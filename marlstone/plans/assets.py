"""A small dependency graph of build steps: each runs after those it needs, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter


@dataclass(frozen=True)
class Asset:
    name: str
    run: Callable[[], object]
    needs: tuple[str, ...] = ()
    retries: int = 2
    delay: float = 10.0


def build(assets: list[Asset]) -> dict[str, str]:
    """The state of each asset, in the order of running: DONE, FAILED (after its retries), or SKIPPED if it needs one that isn't done."""
    by = {a.name: a for a in assets}
    state: dict[str, str] = {}
    for name in TopologicalSorter({a.name: a.needs for a in assets}).static_order():
        asset = by[name]
        if any(state[n] != "DONE" for n in asset.needs):
            state[name] = "SKIPPED"
            continue
        for attempt in range(asset.retries + 1):
            try:
                asset.run()
                state[name] = "DONE"
                break
            except Exception:  # a step may fail for any reason; the last attempt's failure is its state
                state[name] = "FAILED"
                if attempt < asset.retries:
                    time.sleep(asset.delay)
    return state
