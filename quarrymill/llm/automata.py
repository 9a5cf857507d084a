"""Acyclic automata over words with a count for each accepted phrase.

States that accept the same endings with the same counts are one. An automaton is built incrementally from phrases in sorted
order: what no later phrase can extend is looked up among the finished states at once, so that only one path is open.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

Phrase = tuple[str, ...]


class Transducer(NamedTuple):
    """Arcs of state i: first[i] to first[i + 1], by word order; the last state is the start. weights: 0 for no phrase."""

    words: list[str]
    weights: list[int]
    first: list[int]
    labels: list[int]
    targets: list[int]

    def arcs(self, state: int) -> Iterator[tuple[str, int]]:
        words = self.words
        for k in range(self.first[state], self.first[state + 1]):
            yield words[self.labels[k]], self.targets[k]

    def phrases(self) -> Iterator[tuple[Phrase, tuple[int, ...]]]:
        """Every phrase by word order, with the weights of all states on its way (the last is its own)."""
        if not self.weights:
            return
        todo: list[tuple[int, Phrase, tuple[int, ...]]] = [(len(self.weights) - 1, (), ())]
        while todo:
            state, phrase, way = todo.pop()
            if phrase and way[-1]:
                yield phrase, way
            following = [(to, (*phrase, word), (*way, self.weights[to])) for word, to in self.arcs(state)]
            todo += reversed(following)


class Builder:
    """Takes phrases in ascending order, equal ones one after the other; their counts are summed."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.known: dict[tuple, int] = {}
        self.result = Transducer([], [], [0], [], [])
        self.path: Phrase = ()
        #: Weight and arcs of the states along the open path.
        self.open: list[tuple[list[int], list[int]]] = [([0], [])]

    def add(self, phrase: Phrase, count: int) -> None:
        common = 0
        for a, b in zip(phrase, self.path, strict=False):
            if a != b:
                break
            common += 1
        self._close(common)
        for _ in phrase[common:]:
            self.open.append(([0], []))
        self.path = phrase
        self.open[-1][0][0] += count

    def _close(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            (weight,), arcs = self.open.pop()
            label = self.numbers.setdefault(self.path[len(self.open) - 1], len(self.numbers))
            self.open[-1][1].extend((label, self._state(weight, arcs)))

    def _state(self, weight: int, arcs: list[int]) -> int:
        key = (weight, *arcs)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.result.weights)
            self.result.weights.append(weight)
            self.result.labels.extend(arcs[::2])
            self.result.targets.extend(arcs[1::2])
            self.result.first.append(len(self.result.labels))
        return found

    def finish(self) -> Transducer:
        self._close(0)
        (weight,), arcs = self.open[0]
        self.known.clear()  # the start is the last state, whatever it equals
        self._state(weight, arcs)
        self.result.words.extend(self.numbers)
        return self.result


def build(phrases: Iterable[tuple[Phrase, int]]) -> Transducer:
    builder = Builder()
    for phrase, count in phrases:
        builder.add(phrase, count)
    return builder.finish()


def union(parts: list[Transducer], least: int = 1) -> Transducer:
    """All phrases of the parts with their counts summed, those of at least least."""
    builder = Builder()
    held, total = None, 0
    for phrase, way in heapq.merge(*[p.phrases() for p in parts], key=lambda x: x[0]):
        if phrase != held:
            if held is not None and total >= least:
                builder.add(held, total)
            held, total = phrase, 0
        total += way[-1]
    if held is not None and total >= least:
        builder.add(held, total)
    return builder.finish()


def compose(asked: Transducer, counted: Transducer) -> Iterator[tuple[Phrase, int]]:
    """Phrases that both accept, with the counts of the second: both are walked along equal words."""
    if not asked.weights or not counted.weights:
        return
    todo: list[tuple[int, int, Phrase]] = [(len(asked.weights) - 1, len(counted.weights) - 1, ())]
    while todo:
        a, b, phrase = todo.pop()
        if phrase and asked.weights[a] and counted.weights[b]:
            yield phrase, counted.weights[b]
        ways = dict(asked.arcs(a))
        if ways:
            todo += [(ways[word], to, (*phrase, word)) for word, to in counted.arcs(b) if word in ways]


