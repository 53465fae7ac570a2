"""Sequential covering: an ordered list of threshold conjunctions for one class.

Works on a bounded table of labelled statistics.  Each rule grows on two thirds
of what is left, one condition at a time by information gain, is pruned from
its end on the other third, and is kept while it stays precise there.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] > self.value if self.above else data[self.feature] <= self.value

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, data: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for c in rule:
        rows = rows & c.holds(data)
    return rows


def _best(data: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of largest FOIL gain over ``rows``; cuts are midpoints between distinct values."""
    p0, n0 = int(bad[rows].sum()), int(rows.sum())
    base, best = log2((p0 + 1e-9) / n0), (1e-6, None)
    for name in sorted(data):
        x = data[name][rows]
        order = np.argsort(x, kind="stable")
        x, hit = x[order], bad[rows][order]
        cut = np.flatnonzero(x[1:] > x[:-1])
        if not len(cut):
            continue
        below, low = np.cumsum(hit)[cut], cut + 1
        for above, p, n in ((False, below, low), (True, p0 - below, n0 - low)):
            gain = p * (np.log2((p + 1e-9) / n) - base)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Condition(name, above, float((x[cut[i]] + x[cut[i] + 1]) / 2)))
    return best


def learn(data: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 5, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """Ordered rules for ``bad``; deterministic for given rows in a given order.

    ``precision`` is the least share of bad rows among those that a rule covers
    on the pruning rows and on all rows; ``least`` is the fewest rows it covers.
    """
    n = len(bad)
    left = np.ones(n, dtype=bool)
    prune_part = np.arange(n) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < most_rules and bad[left].sum() >= least:
        rows = left & ~prune_part
        rule: Rule = ()
        while len(rule) < most_conditions and rows.any() and bad[rows].any() and not bad[rows].all():
            _, c = _best(data, bad, rows)
            if c is None:
                break
            rule += (c,)
            rows = _covered(rule, data, left & ~prune_part)

        def worth(r: Rule) -> tuple[float, int]:
            hit = _covered(r, data, left & prune_part)
            p = int(bad[hit].sum())
            return ((2 * p - int(hit.sum())) / max(1, int(hit.sum())), -len(r))

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())
        hit = _covered(rule, data, left)
        held = _covered(rule, data, left & prune_part)
        if not rule or hit.sum() < least or bad[hit].mean() < precision or (held.any() and bad[held].mean() < precision):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule holds: one ordered conditional expression."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column()
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))
