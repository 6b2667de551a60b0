"""The epoch driver that every iterative algorithm shares."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation

from graphloom.plans.storage import cut, drop_cut

#: Epochs in one job while few rows changed, and how many rows are few.
TOGETHER, FEW = 4, 1 << 16


@dataclass(frozen=True)
class Epoch:
    """What one epoch counted: ``values`` by the names of the step's metrics."""

    number: int
    values: dict[str, object]


Step = Callable[[DataFrame, int, dict[str, object]], DataFrame]


def _counts(seen: Observation, metrics: dict[str, Column]) -> dict[str, object]:
    """What was observed; an inner epoch that the adaptive plan dropped, as its state is empty, counted nothing."""
    try:
        return seen.get
    except Py4JJavaError:
        return dict.fromkeys(metrics, 0)


def iterate(
    state: DataFrame,
    step: Step,
    metrics: dict[str, Column],
    max_epochs: int,
    first: dict[str, object],
    stop: Callable[[dict[str, object]], bool],
    few: str | None = None,
) -> tuple[DataFrame, list[Epoch]]:
    """Apply ``step`` until ``stop`` holds for an epoch's metrics, or ``max_epochs`` are done.

    ``step`` gets the state, the epoch and the metrics of the epoch before (``first`` at the
    start). Each job's last state goes to reliable storage while its metrics are observed, so
    lineage stays one job deep and a lost executor costs a re-read; the state before is deleted.

    While the metric ``few`` is at most FEW, TOGETHER epochs are one job; for these ``step`` gets no
    metrics, must use its state once, and must leave a settled state as it is.
    """
    trace: list[Epoch] = []
    known, number, stored = first, 0, None
    while number < max_epochs:
        count = min(TOGETHER if few and known[few] <= FEW else 1, max_epochs - number)
        seen = []
        for n in range(number, number + count):
            seen.append(Observation())
            state = step(state, n, known if count == 1 else {}).observe(seen[-1], *[c.alias(m) for m, c in metrics.items()])
        state, before = cut(state), stored
        stored = state
        if before is not None:
            drop_cut(before)
        for one in seen:
            known = {**known, **_counts(one, metrics)}
            trace.append(Epoch(number, known))
            number += 1
            if stop(known):
                return state, trace
    return state, trace
