"""Solver parameters, convergence monitor, logger and timers."""

from __future__ import annotations

import contextlib
import sys
import time
from collections import deque
from dataclasses import dataclass


@dataclass(frozen=True)
class SolverParameters:
    """How far iterations go.  ``threshold`` is where products drop entries."""

    converge_diff: float = 1e-6
    max_iterations: int = 1000
    threshold: float = 0.0
    step_thresh: float = 1e-2
    monitor_convergence: bool = True
    be_verbose: bool = False

    def describe(self) -> dict:
        return dict(self.__dict__)


class Monitor:
    """Decides from the values of an iteration whether it has converged.

    Tight: the last value is within the tolerance.  In automatic mode an
    iteration that has stopped improving counts as well: two moving averages
    and the last value within a factor of ten of each other, the last value
    not negative and no smaller than the one before, all below ``loose``.
    """

    #: Fixed values of the stopping rule: windows, factor and loose tolerance.
    SHORT, LONG, FACTOR, LOOSE = 3, 6, 10.0, 1e-2

    def __init__(self, tight: float, automatic: bool = True):
        self.tight, self.automatic = tight, automatic
        self.values: deque[float] = deque(maxlen=self.LONG)
        self.seen = 0

    def append(self, value: float) -> None:
        self.values.append(value)
        self.seen += 1

    def converged(self) -> bool:
        if not self.values:
            return False
        values = list(self.values)
        last = values[-1]
        if abs(last) <= self.tight:
            return True
        if not self.automatic or self.seen < self.LONG:
            return False
        short, long = sum(values[-self.SHORT :]) / self.SHORT, sum(values) / self.LONG

        def near(x: float, y: float) -> bool:
            return abs(y) / self.FACTOR <= abs(x) <= abs(y) * self.FACTOR

        return near(short, long) and near(last, long) and last >= 0 and abs(last) >= abs(values[-2]) and abs(long) <= self.LOOSE


def iterate(step, state, parameters: SolverParameters):
    """Run ``step(state) -> (state, value)`` until the monitor is satisfied; returns the last state.

    A step may return None as its value to end the loop with its state.
    """
    monitor = Monitor(parameters.converge_diff, parameters.monitor_convergence)
    log = Logger(parameters.be_verbose)
    with log.section("Iterations"):
        for k in range(parameters.max_iterations):
            state, value = step(state)
            if value is None:
                break
            log.item("Round", k, Convergence=value)
            monitor.append(value)
            if monitor.converged():
                break
    return state


class Logger:
    """Nested YAML lines on a stream."""

    def __init__(self, active: bool = True, stream=None):
        self.active, self.stream, self.depth = active, stream or sys.stderr, 0

    def write(self, text: str) -> None:
        if self.active:
            print("  " * self.depth + text, file=self.stream)

    @contextlib.contextmanager
    def section(self, name: str):
        self.write(f"{name}:")
        self.depth += 1
        try:
            yield self
        finally:
            self.depth -= 1

    def element(self, name: str, value) -> None:
        self.write(f"{name}: {value}")

    def item(self, name: str, value, **more) -> None:
        self.write(f"- {name}: {value}")
        for key, v in more.items():
            self.write(f"  {key}: {v}")


class Timers:
    """Named wall-clock timers."""

    def __init__(self):
        self.elapsed: dict[str, float] = {}

    @contextlib.contextmanager
    def run(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.elapsed[name] = self.elapsed.get(name, 0.0) + time.perf_counter() - began

    def report(self) -> str:
        return "\n".join(f"{name}: {s:.3f} s" for name, s in self.elapsed.items())
