"""Weighted finite-state transducers over small alphabets, their composition and best paths.

A transducer reads one symbol (an integer) at each arc and writes one. An arc has a share, the part
of a symbol's weight that it passes on. Composed machines read what the first reads
and write what the second writes, and the shares of their arcs multiply.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass
from functools import reduce

State = Hashable
Arc = tuple[State, int, float]


@dataclass(frozen=True)
class Transducer:
    starts: tuple[State, ...]
    finals: frozenset
    arcs: dict[tuple[State, int], tuple[Arc, ...]]


def machine(starts: Iterable[State], finals: Iterable[State], inputs: Iterable[int], step: Callable[[State, int], list[Arc]]) -> Transducer:
    """The machine of all states that ``step`` reaches from ``starts`` over ``inputs``."""
    arcs, inputs, starts = {}, list(inputs), tuple(starts)
    seen, todo = set(starts), list(starts)
    while todo:
        state = todo.pop()
        for symbol in inputs:
            found = tuple(step(state, symbol))
            if found:
                arcs[state, symbol] = found
            for ahead, _, _ in found:
                if ahead not in seen:
                    seen.add(ahead)
                    todo.append(ahead)
    return Transducer(starts, frozenset(finals) & seen, arcs)


def outputs(of: Transducer) -> set[int]:
    return {out for found in of.arcs.values() for _, out, _ in found}


def compose(first: Transducer, second: Transducer) -> Transducer:
    """``second`` reads what ``first`` writes. States are pairs."""

    def step(state: State, symbol: int) -> list[Arc]:
        return [
            ((a, b), out, share * part)
            for a, between, share in first.arcs.get((state[0], symbol), ())
            for b, out, part in second.arcs.get((state[1], between), ())
        ]

    starts = [(a, b) for a in first.starts for b in second.starts]
    finals = [(a, b) for a in first.finals for b in second.finals]
    return machine(starts, finals, {symbol for _, symbol in first.arcs}, step)


def cascade(machines: Iterable[Transducer]) -> Transducer:
    """All ``machines``, each reading what the one before it writes, as one with numbered states."""
    whole = reduce(compose, machines)
    states = sorted({s for s, _ in whole.arcs} | {a[0] for found in whole.arcs.values() for a in found}, key=repr)
    number = {s: i for i, s in enumerate(states)}
    arcs = {(number[s], symbol): tuple((number[a], out, share) for a, out, share in found) for (s, symbol), found in whole.arcs.items()}
    return Transducer(tuple(number[s] for s in whole.starts if s in number), frozenset(number[s] for s in whole.finals), arcs)


def best_path(of: Transducer, symbols: Iterable[int], weights: Iterable[float]) -> tuple[float, list[tuple[int, int, float]]] | None:
    """The weight of the heaviest accepted path and its written symbols other than 0, each as
    (place, symbol, weight); None if no path is accepted."""
    paths = {state: (0.0, None) for state in of.starts}
    for place, (symbol, weight) in enumerate(zip(symbols, weights)):
        ahead: dict = {}
        for state, (total, written) in paths.items():
            for to, out, share in of.arcs.get((state, symbol), ()):
                part = share * weight if out else 0.0
                if to not in ahead or total + part > ahead[to][0]:
                    ahead[to] = (total + part, (written, place, out, part) if out else written)
        paths = ahead
    ends = [paths[state] for state in of.finals if state in paths]
    if not ends:
        return None
    total, written = max(ends, key=lambda end: end[0])
    found = []
    while written:
        written, *match = written
        found.append(tuple(match))
    return total, found[::-1]
