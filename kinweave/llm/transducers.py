"""Weighted finite-state transducers: composition and the path of the largest weight."""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field

State = Hashable


@dataclass
class Transducer:
    """Arcs ``arcs[state][input] = [(output, weight, next state), ...]``, with weights of the final states.

    A symbol without an arc ends a path; so does a text that ends in a state that is not final.
    """

    start: State
    finals: dict[State, float] = field(default_factory=dict)
    arcs: dict[State, dict[str, list[tuple[str, float, State]]]] = field(default_factory=dict)

    def add(self, state: State, symbols: Iterable[str], to: State, output: str | None = None, weight: float = 0.0) -> None:
        """An arc for each of the symbols, which writes ``output`` or else what it has read."""
        for symbol in symbols:
            self.arcs.setdefault(state, {}).setdefault(symbol, []).append((symbol if output is None else output, weight, to))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What the second makes of the output of the first: the pairs of states that can be reached."""
    start = (first.start, second.start)
    out, todo = Transducer(start), [start]
    seen = {start}
    while todo:
        pair = a, b = todo.pop()
        if a in first.finals and b in second.finals:
            out.finals[pair] = first.finals[a] + second.finals[b]
        for symbol, arcs in first.arcs.get(a, {}).items():
            for middle, weight, a_to in arcs:
                for output, more, b_to in second.arcs.get(b, {}).get(middle, ()):
                    to = (a_to, b_to)
                    out.add(pair, (symbol,), to, output, weight + more)
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
    return out


def numbered(machine: Transducer) -> Transducer:
    """The same transducer with numbers for states, which are quicker to look up than nested pairs."""
    states = {machine.start: 0}
    for arcs in machine.arcs.values():
        for found in arcs.values():
            for _, _, to in found:
                states.setdefault(to, len(states))
    for state in machine.arcs:
        states.setdefault(state, len(states))
    return Transducer(0, {states[s]: w for s, w in machine.finals.items() if s in states}, {
        states[s]: {symbol: [(output, weight, states[to]) for output, weight, to in found] for symbol, found in arcs.items()}
        for s, arcs in machine.arcs.items()})


def best_path(machine: Transducer, readings: Iterable[tuple[tuple[str, float], ...]], silent: str) -> tuple[float, list[tuple[str, float]]] | None:
    """Weight of the heaviest path and its outputs other than ``silent`` with their weights; None without a path.

    A position may be read as one of several symbols, each with a weight. A state keeps its best path
    only, as a list linked backwards, so memory grows with what is matched. Of equal paths, the first counts.
    """
    reached = {machine.start: (0.0, None)}
    for options in readings:
        further: dict[State, tuple[float, tuple | None]] = {}
        for state, (total, path) in reached.items():
            arcs = machine.arcs.get(state, {})
            for symbol, own in options:
                for output, weight, to in arcs.get(symbol, ()):
                    sum_here = total + own + weight
                    if to not in further or sum_here > further[to][0]:
                        further[to] = (sum_here, path if output == silent else (output, own + weight, path))
        reached = further
    best = None
    for state, (total, path) in reached.items():
        if state in machine.finals and (best is None or total + machine.finals[state] > best[0]):
            best = (total + machine.finals[state], path)
    if best is None:
        return None
    outputs, path = [], best[1]
    while path is not None:
        outputs.append(path[:2])
        path = path[2]
    return best[0], outputs[::-1]
