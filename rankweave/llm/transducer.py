"""Weighted acyclic automata over words: phrases in, counts out.

A state is a run of arcs (label, target, weight); the weight of a phrase stands on its last arc, and 0
means that the path is no phrase of its own. Labels are places in the automaton's sorted alphabet.
State 0 has no arcs, the last state is the root.

``build`` takes sorted phrases and works like the incremental construction of minimal automata: a state is
frozen as soon as the last phrase with its prefix has been read, and a state whose arcs equal those of a frozen one
is that one. ``union`` adds weights of equal phrases up; ``compose`` walks two automata at once.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

ARC = np.dtype([("label", "<i4"), ("target", "<i4"), ("weight", "<i8")])


class Transducer(NamedTuple):
    words: list[bytes]       # the alphabet, sorted
    starts: np.ndarray       # first arc of each state, and the number of arcs
    arcs: np.ndarray         # ARC, labels of a state in order
    total: int = 0           # weight of the empty phrase

    @property
    def root(self) -> int:
        return len(self.starts) - 2

    def follow(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs out of these states: (place of the state among them, place of the arc)."""
        sizes = self.starts[states + 1] - self.starts[states]
        row = np.repeat(np.arange(len(states)), sizes)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.starts[states][row]

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """(labels, weights) of all phrases; rows are filled up with -1."""
        found, states, before = [], np.array([self.root]), np.zeros((1, 0), np.int32)
        while len(states):
            row, at = self.follow(states)
            arcs = self.arcs[at]
            here = np.concatenate([before[row], arcs["label"][:, None]], axis=1)
            ends, goes = arcs["weight"] > 0, arcs["target"] > 0
            found.append((here[ends], arcs["weight"][ends]))
            states, before = arcs["target"][goes], here[goes]
        width = max((x.shape[1] for x, _ in found), default=1)
        padded = [np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=-1) for x, _ in found]
        return np.concatenate(padded), np.concatenate([w for _, w in found])

    def phrases(self) -> list[tuple[tuple[bytes, ...], int]]:
        labels, weights = self.paths()
        words = self.words
        return [(tuple(words[x] for x in row if x >= 0), w) for row, w in zip(labels.tolist(), weights.tolist(), strict=True)]


def _in_order(labels: np.ndarray) -> np.ndarray:
    return np.lexsort(labels.T[::-1])


def _new(labels: np.ndarray) -> np.ndarray:
    """Rows that differ from the one before."""
    return np.concatenate([np.ones(min(1, len(labels)), bool), (labels[1:] != labels[:-1]).any(axis=1)])


def build(words: list[bytes], labels: np.ndarray, weights: np.ndarray, total: int = 0) -> Transducer:
    """The minimal automaton of sorted, distinct phrases (rows of labels, filled up with -1)."""
    depth = labels.shape[1]
    rows, layers, arc_of, ends = [], [], [], []
    sizes = (labels >= 0).sum(axis=1)
    for d in range(1, depth + 1):
        changes = _new(labels[:, :d])
        first = changes & (sizes >= d)               # rows that bring a new prefix of this length
        at = np.flatnonzero(first)
        layer = np.zeros(len(at), ARC)
        layer["label"] = labels[at, d - 1]
        layer["weight"] = np.where(sizes[at] == d, weights[at], 0)
        rows.append(at)
        layers.append(layer)
        arc_of.append(np.cumsum(first) - 1)          # the prefix that a row goes on from
        ends.append(np.concatenate([np.flatnonzero(changes)[1:], [len(labels)]])[(np.cumsum(changes) - 1)[at]] - 1)
    # (last row with the prefix, depth, arc, its first and last arc below) of every state but the root
    closing = []
    for d in range(1, depth):
        parents = arc_of[d - 1][rows[d]]
        arcs = np.unique(parents)
        begin, end = np.searchsorted(parents, arcs), np.searchsorted(parents, arcs, side="right")
        closing.append(np.stack([ends[d - 1][arcs], np.full(len(arcs), -d), arcs, begin, end], axis=1))
    events = np.concatenate(closing) if closing else np.zeros((0, 5), np.int64)
    events = events[np.lexsort((events[:, 1], events[:, 0]))]

    size = ARC.itemsize
    raw = [memoryview(x.view(np.uint8)) if len(x) else memoryview(b"") for x in layers]
    targets = [x["target"] for x in layers]
    register: dict[bytes, int] = {}
    frozen, starts, n = [], [0, 0], 0
    for d, arc, begin, end in zip((-events[:, 1]).tolist(), *events[:, 2:].T.tolist(), strict=True):
        key = bytes(raw[d][size * begin:size * end])
        state = register.get(key)
        if state is None:
            state = register[key] = len(starts) - 1
            frozen.append(key)
            n += end - begin
            starts.append(n)
        targets[d - 1][arc] = state
    frozen.append(layers[0].tobytes())
    starts.append(n + len(layers[0]))
    return Transducer(words, np.array(starts, dtype=np.int64), np.frombuffer(b"".join(frozen), ARC), total)


def of_phrases(counts: dict[tuple[bytes, ...], int], total: int = 0) -> Transducer:
    """The automaton of phrases with their counts."""
    words = sorted({w for p in counts for w in p})
    place = {w: k for k, w in enumerate(words)}
    width = max(map(len, counts), default=1)
    labels = np.array([[place[w] for w in p] + [-1] * (width - len(p)) for p in counts], dtype=np.int32).reshape(-1, width)
    weights = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    order = _in_order(labels)
    return build(words, labels[order], weights[order], total)


def union(parts: Iterable[Transducer], least: int = 1) -> Transducer:
    """One automaton of all parts' phrases with their weights added up; lighter phrases than ``least`` are left out."""
    parts = list(parts)
    words = sorted(set().union(*[t.words for t in parts]))
    place = {w: k for k, w in enumerate(words)}
    found = []
    for t in parts:
        labels, weights = t.paths()
        here = np.array([place[w] for w in t.words] + [-1], dtype=np.int32)  # the last one serves label -1
        found.append((here[labels], weights))
    width = max((x.shape[1] for x, _ in found), default=1)
    labels = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=-1) for x, _ in found] or [np.zeros((0, 1), np.int32)])
    weights = np.concatenate([w for _, w in found] or [np.zeros(0, np.int64)])
    order = _in_order(labels)
    labels, weights = labels[order], weights[order]
    first = np.flatnonzero(_new(labels))
    if len(first):
        labels, weights = labels[first], np.add.reduceat(weights, first)
        labels, weights = labels[weights >= least], weights[weights >= least]
    words, labels = narrowed(words, labels)
    return build(words, labels, weights, sum(t.total for t in parts))


def narrowed(words: list[bytes], labels: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The alphabet without words that no phrase has, and labels in it."""
    used = np.unique(labels)
    used = used[used >= 0]
    place = np.full(len(words) + 1, -1, dtype=np.int32)  # the last one serves label -1
    place[used] = np.arange(len(used))
    return [words[k] for k in used.tolist()], place[labels]


def compose(asked: Transducer, counts: Transducer) -> list[tuple[tuple[bytes, ...], int]]:
    """The phrases of ``asked`` that ``counts`` has, with the weights there."""
    place = {w: k for k, w in enumerate(counts.words)}
    here = np.array([place.get(w, -1) for w in asked.words], dtype=np.int64)
    width = len(counts.words) + 1
    state_of = np.repeat(np.arange(len(counts.starts) - 1), np.diff(counts.starts))
    keys = state_of * width + counts.arcs["label"]  # in order: states by number, labels of a state in order
    a, c, before = np.array([asked.root]), np.array([counts.root]), np.zeros((1, 0), np.int32)
    out = []
    while len(a) and len(keys):
        row, at = asked.follow(a)
        arcs = asked.arcs[at]
        wanted = c[row] * width + here[arcs["label"]]
        place_of = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        met = (keys[place_of] == wanted) & (here[arcs["label"]] >= 0)
        row, arcs, other = row[met], arcs[met], counts.arcs[place_of[met]]
        now = np.concatenate([before[row], arcs["label"][:, None]], axis=1)
        ends = (arcs["weight"] > 0) & (other["weight"] > 0)
        out += [(tuple(asked.words[x] for x in p), w) for p, w in zip(now[ends].tolist(), other["weight"][ends].tolist(), strict=True)]
        goes = (arcs["target"] > 0) & (other["target"] > 0)
        a, c, before = arcs["target"][goes].astype(np.int64), other["target"][goes].astype(np.int64), now[goes]
    return out
