"""A minimal acyclic transducer from terms, as bytes, to their lexicographic ordinals, built and walked inside tasks.

States are kept as one sorted array of edges, keyed by state and byte. An edge puts out how many terms come
before all that continue through it, so the sum along a term's path is its ordinal. States that accept the
same endings are one state: the automaton is minimal, and much smaller than the list of terms.
"""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np


class Transducer(NamedTuple):
    """``keys``: state * 256 + byte of each edge, sorted; state 0 is the start."""

    keys: np.ndarray
    targets: np.ndarray
    outputs: np.ndarray
    accepting: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self._asdict())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        held = np.load(io.BytesIO(data))
        return cls(*(held[name] for name in cls._fields))

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in self)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinals of the strings ``data[start:end]``, -1 for those that are no term. All walk side by side, one byte a step."""
        found = np.full(len(starts), -1, np.int64)
        active, at = np.arange(len(starts)), starts.astype(np.int64)
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        while len(active):
            ended = at == ends[active]
            over = ended & self.accepting[state]
            found[active[over]] = total[over]
            active, at, state, total = (x[~ended] for x in (active, at, state, total))
            if not len(active) or not len(self.keys):
                break
            key = state * 256 + data[at]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[edge] == key
            edge = edge[goes]
            active, at = active[goes], at[goes] + 1
            state, total = self.targets[edge].astype(np.int64), total[goes] + self.outputs[edge]
        return found


def build(terms) -> Transducer:
    """Of distinct terms in ascending order of bytes, added one by one.

    States of the last term's path are still open; when the next term leaves the path, those below are closed:
    replaced by an equal state where there is one.
    """
    # Of closed states: (accepting, ((byte, state), ...)) -> number; how many terms each accepts.
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    counts: list[int] = []
    path: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            accepting, edges = path.pop()
            made = (accepting, tuple(edges))
            number = register.get(made)
            if number is None:
                number = register[made] = len(states)
                states.append(made)
                counts.append(accepting + sum(counts[target] for _, target in edges))
            parent = path[-1][1]
            parent[-1] = (parent[-1][0], number)

    for term in terms:
        if term <= last and (last or path[0][0]):
            raise ValueError("terms must ascend")
        same = 0
        while same < len(last) and last[same] == term[same]:
            same += 1
        close(same)
        for byte in term[same:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = term
    close(0)
    states.append((path[0][0], tuple(path[0][1])))

    # The start was closed last; numbered from the end it is state 0.
    top = len(states) - 1
    keys, targets, outputs = [], [], []
    for number in range(top, -1, -1):
        accepting, edges = states[number]
        before = int(accepting)
        for byte, target in edges:
            keys.append((top - number) * 256 + byte)
            targets.append(top - target)
            outputs.append(before)
            before += counts[target]
    accepting = np.array([states[number][0] for number in range(top, -1, -1)], bool)
    return Transducer(np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int64), accepting)
