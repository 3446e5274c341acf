"""Weighted finite-state transducers in the max-plus semiring: arcs carry an input, an output and a weight; the weight of a
path is the sum of its arcs', and a string's score is that of its best accepted path."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence
from dataclasses import dataclass, field

Symbol = Hashable


@dataclass
class Transducer:
    """States are numbers. arcs: (state, input) to a list of (output, weight, next state)."""

    initial: set[int]
    final: set[int]
    arcs: dict[tuple[int, Symbol], list[tuple[Symbol, float, int]]] = field(default_factory=dict)

    def add(self, state: int, read: Symbol, write: Symbol, weight: float, to: int) -> None:
        self.arcs.setdefault((state, read), []).append((write, weight, to))

    def best(self, string: Sequence[Symbol]) -> float | None:
        """The largest weight of an accepted path that reads the string; None if there is none."""
        at = dict.fromkeys(self.initial, 0.0)
        for read in string:
            after: dict[int, float] = {}
            for state, weight in at.items():
                for _, more, to in self.arcs.get((state, read), ()):
                    if weight + more > after.get(to, float("-inf")):
                        after[to] = weight + more
            at = after
        return max((w for s, w in at.items() if s in self.final), default=None)

    def paths(self, string: Sequence[Symbol]) -> Iterable[tuple[tuple[Symbol, ...], float]]:
        """Every accepted path's output and weight, by plain enumeration."""

        def go(state: int, k: int, out: tuple, weight: float):
            if k == len(string):
                if state in self.final:
                    yield out, weight
                return
            for write, more, to in self.arcs.get((state, string[k]), ()):
                yield from go(to, k + 1, (*out, write), weight + more)

        for state in sorted(self.initial):
            yield from go(state, 0, (), 0.0)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads as the first, hands its output to the second and writes what that writes; weights add up. Only states that a start reaches are made."""
    by_input: dict[int, dict[Symbol, list[tuple[Symbol, float, int]]]] = {}
    for (state, read), arcs in second.arcs.items():
        by_input.setdefault(state, {})[read] = arcs
    of_first: dict[int, list[tuple[Symbol, Symbol, float, int]]] = {}
    for (state, read), arcs in first.arcs.items():
        of_first.setdefault(state, []).extend((read, *arc) for arc in arcs)
    number: dict[tuple[int, int], int] = {}
    todo: list[tuple[int, int]] = []

    def state_of(pair: tuple[int, int]) -> int:
        if pair not in number:
            number[pair] = len(number)
            todo.append(pair)
        return number[pair]

    out = Transducer({state_of((a, b)) for a in sorted(first.initial) for b in sorted(second.initial)}, set())
    while todo:
        pair = todo.pop()
        a, b = pair
        if a in first.final and b in second.final:
            out.final.add(number[pair])
        for read, write, weight, to in of_first.get(a, ()):
            for said, more, then in by_input.get(b, {}).get(write, ()):
                out.add(number[pair], read, said, weight + more, state_of((to, then)))
    return out


def trimmed(t: Transducer) -> Transducer:
    """Without states from which no end can be reached."""
    back: dict[int, set[int]] = {}
    for (state, _), arcs in t.arcs.items():
        for *_, to in arcs:
            back.setdefault(to, set()).add(state)
    live, todo = set(t.final), list(t.final)
    while todo:
        for s in back.get(todo.pop(), ()):
            if s not in live:
                live.add(s)
                todo.append(s)
    arcs = {key: kept for key, every in t.arcs.items() if key[0] in live and (kept := [x for x in every if x[2] in live])}
    return Transducer(t.initial & live, t.final & live, arcs)
