"""State machines along a series as chains of bars, so that a stretch of bars is a small table from start to end states.

Where a position or trade ends follows from the bar at which it begins; so from any bar the machine is one chain, chains
meet soon, and a stretch needs few of them, whatever state it starts in.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np


def run_ends(x: np.ndarray) -> np.ndarray:
    """For each place the first later one with another value; the length if there is none."""
    cuts = np.append(np.flatnonzero(x[1:] != x[:-1]) + 1, len(x))
    return cuts[np.searchsorted(cuts, np.arange(len(x)), side="right")]


@dataclass(frozen=True)
class Holding:
    """A position follows its target, but stays n bars at least; n is the value ``n`` of the rows.

    The state is (position, bars that it must still stay). A position that must stay r bars more is left at bar r or,
    if its own value is wanted there, where another one is wanted next. So a table has for each r the value wanted, and
    the end state for a position of another value and for one of that value.
    """

    before = after = 0
    start = (0.0, 0.0)

    def _next(self, want: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        size, ends = len(want), run_ends(want)
        j = np.arange(size) + np.where(want != 0, n, 1)
        at = np.minimum(j, size - 1)
        return np.where(j >= size, size, np.where(want[at] != want, j, ends[at])), ends

    def table(self, values: dict[str, np.ndarray], first: int, own: int) -> list[float]:
        want, n = values["target"][first : first + own], max(1, int(values["n"][first]))
        following, ends = self._next(want, n)
        step = following.tolist()
        last: dict[int, int] = {}

        def end(at: int) -> tuple[float, float, float]:
            path = []
            while at not in last and step[at] < own:
                path.append(at)
                at = step[at]
            final = last.setdefault(at, at)
            last.update(dict.fromkeys(path, final))
            return 1.0, float(want[final]), float(max(0, final + n - own)) if want[final] else 0.0

        out: list[float] = []
        for r in range(min(n, own)):
            other, same = end(r), end(int(ends[r])) if ends[r] < own else (0.0, 0.0, 0.0)
            out += [float(want[r]), *other, *same]
        return out

    def step(self, state: list[float], table: np.ndarray, own: int) -> tuple[float, float]:
        pos, stay = state[0], int(state[1])
        if stay >= own:
            return pos, float(stay - own)
        row = table[7 * stay : 7 * stay + 7]
        moved, to, left = row[1:4] if pos != row[0] else row[4:7]
        return (float(to), float(left)) if moved else (pos, 0.0)

    def walk(self, values: dict[str, np.ndarray], first: int, own: int, state: list[float]) -> tuple[np.ndarray, list[np.ndarray]]:
        want, n = values["target"][first : first + own], max(1, int(values["n"][first]))
        following, ends = self._next(want, n)
        pos, at = np.full(own, state[0]), int(state[1])
        if at < own:
            at = at if want[at] != state[0] else int(ends[at])
            while at < own:
                pos[at : following[at]] = want[at]
                at = int(following[at])
        return np.arange(first, first + own), [pos]


def trade_end(signal: np.ndarray, ret: np.ndarray, i: int, tp: float, sl: float, max_hold: int, least: int) -> tuple[int, str | None]:
    """The last bar of a trade that begins at bar i, and why it ends; None at the end of the series.

    It ends at the first bar after i where the running gain has reached ``tp`` or ``-sl`` or the signal is opposite, each
    from ``least`` bars on, or that is its ``max_hold``-th bar; that bar is found in the running sums of the bars ahead.
    """
    side, ahead = signal[i], slice(i, i + max(2, max_hold))
    gain, bars = np.cumsum(side * ret[ahead]), np.arange(1, len(ret[ahead]) + 1)
    ripe = (bars >= least) & (bars > 1)
    reasons = {"tp": ripe & (gain >= tp), "sl": ripe & (gain <= -sl), "timeout": (bars >= max_hold) & (bars > 1), "invalidate": ripe & (signal[ahead] != 0) & (signal[ahead] != side)}
    ends = np.flatnonzero(np.any(list(reasons.values()), axis=0))
    if not len(ends):
        return len(signal) - 1, None
    last = int(ends[0])
    return i + last, next(name for name, at in reasons.items() if at[last])


@dataclass(frozen=True)
class Trading:
    """Trades that follow a signal (or its changes, with ``on_flip``) until a take-profit, stop, timeout or opposite signal, then rest.

    The state is the number of bars until a trade may begin. A stretch tells of all trades that begin in it, to their
    ends in the bars after it, and of nothing before its first free bar, so each bar is told of once.
    """

    tp: float
    sl: float
    max_hold: int
    least: int
    cooldown: int
    on_flip: bool
    before = 1
    start = (0.0,)

    @property
    def after(self) -> int:
        return max(2, self.max_hold) + self.cooldown + 1

    def _starts(self, signal: np.ndarray, first: int, own: int) -> np.ndarray:
        changed = signal != np.concatenate([[0.0], signal[:-1]])
        starts = np.flatnonzero((signal != 0) & (changed | (not self.on_flip)))
        return starts[(starts >= first) & (starts < first + own)]

    def _end(self, values: dict[str, np.ndarray], i: int) -> tuple[int, str | None]:
        return trade_end(values["signal"], values["ret"], i, self.tp, self.sl, self.max_hold, self.least)

    def table(self, values: dict[str, np.ndarray], first: int, own: int) -> list[float]:
        starts = self._starts(values["signal"], first, own).tolist()
        free: dict[int, float] = {}
        after: dict[int, int] = {}
        out = []
        for f in range(min(self.after, own)):
            path, k = [], bisect_left(starts, first + f)
            at = first + f
            while k < len(starts) and k not in free:
                path.append(k)
                if k not in after:
                    after[k] = self._end(values, starts[k])[0] + 1 + self.cooldown
                at = after[k]
                k = bisect_left(starts, at)
            end = free[k] if k < len(starts) else float(max(0, at - first - own))
            free.update(dict.fromkeys(path, end))
            out.append(end)
        return out

    def step(self, state: list[float], table: np.ndarray, own: int) -> tuple[float]:
        f = int(state[0])
        return (float(table[f]) if f < own else float(f - own),)

    def walk(self, values: dict[str, np.ndarray], first: int, own: int, state: list[float]) -> tuple[np.ndarray, list]:
        signal = values["signal"]
        starts = self._starts(signal, first, own).tolist()
        pos, reason = np.zeros(len(signal)), np.full(len(signal), None, dtype=object)
        begin = at = first + int(state[0])
        while (k := bisect_left(starts, at)) < len(starts):
            i = starts[k]
            last, why = self._end(values, i)
            pos[i : last + 1], reason[last] = signal[i], why
            at = last + 1 + self.cooldown
        told = np.arange(begin, min(len(signal), max(at, first + own))) if begin < first + own else np.arange(0)
        return told, [pos[told], reason[told].tolist()]
