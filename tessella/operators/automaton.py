"""Many values looked for in many texts at once: Aho-Corasick automata over numpy tables.

An automaton holds the first DEPTH bytes of each value; where one ends in a text, longer values are compared there. Its
states and moves are built level by level with array operations, and texts are read in lanes: segments of all texts of a
batch take a step at the same time, so a byte costs some nanoseconds whatever the number of values. Values are dealt
over automata of at most STATES states; a text is read once for each of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np

DEPTH, STATES, LANE = 12, 40_000, 2_048


class Automaton:
    """values: distinct, not empty, in UTF-8."""

    def __init__(self, values: list[bytes], depth: int = DEPTH):
        self.depth = depth
        heads = sorted({v[:depth] for v in values})
        order = {h: k for k, h in enumerate(heads)}
        #: By head: the value that it is (or -1), and longer values by their length.
        self.exact = np.full(len(heads), -1, np.int64)
        self.longer: list[dict[int, dict[bytes, int]]] = [defaultdict(dict) for _ in heads]
        for k, v in enumerate(values):
            if len(v) <= depth:
                self.exact[order[v]] = k
            else:
                self.longer[order[v[:depth]]][len(v)][v] = k
        self.more = np.array([bool(x) for x in self.longer])
        # bytes that no head holds are one class, 0, which leads to the root from everywhere
        used = np.unique(np.frombuffer(b"".join(heads), np.uint8))
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        n, sizes = len(heads), np.array([len(h) for h in heads])
        padded = np.zeros((n, depth), np.int64)
        for k, h in enumerate(heads):
            padded[k, : len(h)] = self.classes[np.frombuffer(h, np.uint8)]
        levels, at, count = [], np.zeros(n, np.int64), 1  # per level: new states, their parents and classes
        ends = np.zeros(n, np.int64)
        for d in range(depth):
            live = np.flatnonzero(sizes > d)
            edges, back = np.unique(at[live] * width + padded[live, d], return_inverse=True)
            states = count + np.arange(len(edges))
            at[live] = states[back]
            done = live[sizes[live] == d + 1]
            ends[done] = at[done]
            levels.append((states, edges // width, edges % width))
            count += len(edges)
        self.head = np.full(count, -1, np.int64)
        self.head[ends] = np.arange(n)
        self.moves = np.zeros((count, width), np.int32)
        self.link = np.zeros(count, np.int64)  # next shorter state in which a head ends
        fail = np.zeros(count, np.int64)
        for states, parents, cls in levels[:1]:
            self.moves[parents, cls] = states
        for d, (states, parents, cls) in enumerate(levels):
            if d:
                # read before the parents' rows get their children: what a parent's failure leads to
                fail[states] = self.moves[fail[parents], cls]
            self.link[states] = np.where(self.head[fail[states]] >= 0, fail[states], self.link[fail[states]])
            self.moves[states] = self.moves[fail[states]]
            if d + 1 < depth:
                below, above, on = levels[d + 1]
                self.moves[above, on] = below
        self.found = (self.head >= 0) | (self.link > 0)

    def ends(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in flat (classes of bytes) where heads end, and which head; in no order."""
        n, lead = len(flat), self.depth - 1
        lanes = max(1, -(-n // LANE))
        padded = np.zeros(lead + lanes * LANE, np.int64)
        padded[lead : lead + n] = flat
        start = np.arange(lanes) * LANE
        state = np.zeros(lanes, np.int64)
        places, states = [], []
        for t in range(lead + LANE):
            state = self.moves[state, padded[start + t]]
            if t >= lead:  # before that a lane only reads itself in
                hit = np.flatnonzero(self.found[state])
                if len(hit):
                    places.append(start[hit] + t - lead)
                    states.append(state[hit].astype(np.int64))
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, at = np.concatenate(places), np.concatenate(states)
        at = np.where(self.head[at] >= 0, at, self.link[at])
        out_p, out_h = [], []
        while len(place):
            out_p.append(place)
            out_h.append(self.head[at])
            at = self.link[at]
            place, at = place[at > 0], at[at > 0]
        return np.concatenate(out_p), np.concatenate(out_h)

    def held(self, texts: list[bytes]) -> set[tuple[int, int]]:
        """(text, value) by number, of every value that a text holds."""
        whole = b"\x00".join(texts)
        flat = self.classes[np.frombuffer(whole, np.uint8)]
        sizes = np.array([len(t) for t in texts], np.int64)
        start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        flat[start[1:] - 1] = 0  # separators, even where values hold that byte
        place, head = self.ends(flat)
        of = np.searchsorted(start, place, "right") - 1
        plain = self.exact[head] >= 0
        out = set(zip(of[plain].tolist(), self.exact[head[plain]].tolist()))
        rest = self.more[head]
        for p, t, h in zip(place[rest].tolist(), of[rest].tolist(), head[rest].tolist()):
            begin, end = p - self.depth + 1, int(start[t] + sizes[t])
            for length, among in self.longer[h].items():
                if begin + length <= end and (k := among.get(whole[begin : begin + length])) is not None:
                    out.add((t, k))
        return out


def automata(values: Iterable[bytes], states: int = STATES, depth: int = DEPTH) -> list[tuple[list[bytes], Automaton]]:
    """Values, sorted so that heads share their beginnings, dealt over automata of at most so many states."""
    out, part, size, last = [], [], 0, b""
    for v in sorted(set(values) - {b""}):
        head = v[:depth]
        shared = next((k for k, (a, b) in enumerate(zip(head, last)) if a != b), min(len(head), len(last)))
        if part and size + len(head) - shared > states:
            out.append(part)
            part, size, shared = [], 0, 0
        part.append(v)
        size, last = size + len(head) - shared, head
    return [(p, Automaton(p, depth)) for p in [*out, *([part] if part else [])]]
