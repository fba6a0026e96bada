"""Selection strategies: which members of a set are picked.

``STRATEGIES`` maps an id to a Strategy. ``keep`` builds the condition on a member from the facts of its
pool; ``decides`` says, from these facts alone, whether it picks some and not all. So every strategy of
a cascade works from one aggregate per set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Facts of a pool: columns p_n, p_dated, p_ts_min, p_ts_max, p_size_min, p_size_max, p_match, p_pick.
Condition = Callable[[], Column]


@dataclass(frozen=True)
class Strategy:
    name: str
    keep: Condition
    decides: Condition
    timed: bool = False


def _col(name: str) -> Condition:
    return lambda: F.col(name)


_ts, _size = _col("timestamp"), _col("size")


def _apart(low: str, high: str) -> Condition:
    return lambda: F.col(low) < F.col(high)


_BASE = [
    Strategy("select-older", lambda: _ts() < F.col("p_ts_max"), _apart("p_ts_min", "p_ts_max"), True),
    Strategy("select-oldest", lambda: _ts() == F.col("p_ts_min"), _apart("p_ts_min", "p_ts_max"), True),
    Strategy("select-newer", lambda: _ts() > F.col("p_ts_min"), _apart("p_ts_min", "p_ts_max"), True),
    Strategy("select-newest", lambda: _ts() == F.col("p_ts_max"), _apart("p_ts_min", "p_ts_max"), True),
    Strategy("select-smaller", lambda: _size() < F.col("p_size_max"), _apart("p_size_min", "p_size_max")),
    Strategy("select-smallest", lambda: _size() == F.col("p_size_min"), _apart("p_size_min", "p_size_max")),
    Strategy("select-bigger", lambda: _size() > F.col("p_size_min"), _apart("p_size_min", "p_size_max")),
    Strategy("select-biggest", lambda: _size() == F.col("p_size_max"), _apart("p_size_min", "p_size_max")),
    Strategy("select-matching-path", lambda: F.col("matches"), lambda: (F.col("p_match") > 0) & (F.col("p_match") < F.col("p_n"))),
    Strategy("select-non-matching-path", lambda: ~F.col("matches"), lambda: (F.col("p_match") > 0) & (F.col("p_match") < F.col("p_n"))),
    Strategy("select-one", lambda: F.col("repr") == F.col("p_pick")["repr"], lambda: F.col("p_n") > 1),
    Strategy("select-all-but-one", lambda: F.col("repr") != F.col("p_pick")["repr"], lambda: F.col("p_n") > 1),
]
# Names of the same choices by what they leave out.
ALIASES = {
    "discard-newest": "select-older",
    "discard-newer": "select-oldest",
    "discard-oldest": "select-newer",
    "discard-older": "select-newest",
    "discard-biggest": "select-smaller",
    "discard-bigger": "select-smallest",
    "discard-smallest": "select-bigger",
    "discard-smaller": "select-biggest",
    "discard-non-matching-path": "select-matching-path",
    "discard-matching-path": "select-non-matching-path",
    "discard-all-but-one": "select-one",
    "discard-one": "select-all-but-one",
}
STRATEGIES: dict[str, Strategy] = {s.name: s for s in _BASE}
STRATEGIES |= {alias: STRATEGIES[name] for alias, name in ALIASES.items()}


def canonical(names: Iterable[str]) -> tuple[str, ...]:
    """Known ids, each choice once (under its first name), in order."""
    out: dict[str, str] = {}
    for name in names:
        if name not in STRATEGIES:
            raise ValueError(f"no such strategy: {name}")
        out.setdefault(STRATEGIES[name].name, name)
    return tuple(out.values())


def register(strategy: Strategy, *aliases: str) -> None:
    for name in (strategy.name, *aliases):
        STRATEGIES[name] = strategy
