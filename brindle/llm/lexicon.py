"""A word lexicon as a minimal acyclic transducer in one memory-mapped file.

Sorted words go into an automaton that shares prefixes as they come and
suffixes as states are frozen (equal right languages become one state). Each
edge carries the number of words that sort before those behind it; the sum
along a path is the word's place, and its ids stand there in a flat table. A
batch of words is looked up at once: all walk one byte at a time.
"""

from __future__ import annotations

import numpy as np

ARRAYS = (("edges", "<i8"), ("target", "<i4"), ("before", "<i4"), ("final", "u1"), ("start", "<i8"), ("ids", "<u4"))


def build(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The automaton's arrays for words (no empty one) and their ids."""
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple]] = []  # of each state: final, ((byte, target), ...)

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open nodes from the root; path[k] is reached by the word's first k bytes
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))

    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        close(common)
        path.extend([False, []] for _ in range(len(w) - common))
        path[-1][0] = True
        last = w
    close(0)
    root = freeze(path[0])
    count = [0] * len(frozen)
    for s, (final, out) in enumerate(frozen):  # targets are frozen before their sources
        count[s] = final + sum(count[t] for _, t in out)
    order = [root, *[s for s in range(len(frozen)) if s != root]]  # the root is state 0
    name = {s: i for i, s in enumerate(order)}
    edges, target, before = [], [], []
    for s in order:
        final, out = frozen[s]
        seen = int(final)
        for byte, t in out:
            edges.append(name[s] << 8 | byte)
            target.append(name[t])
            before.append(seen)
            seen += count[t]
    flat = [entries[w] for w in words]
    start = np.zeros(len(words) + 1, "<i8")
    np.cumsum([len(x) for x in flat], out=start[1:])
    return {
        "edges": np.array(edges, "<i8"), "target": np.array(target, "<i4"), "before": np.array(before, "<i4"),
        "final": np.array([frozen[s][0] for s in order], "u1"), "start": start, "ids": np.array([i for x in flat for i in x], "<u4"),
    }


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """The file's content: the sizes of the arrays, and each array, padded to eight bytes."""
    parts = [np.array([len(arrays[k]) for k, _ in ARRAYS], "<i8").tobytes()]
    for k, kind in ARRAYS:
        own = arrays[k].astype(kind).tobytes()
        parts.append(own + b"\0" * (-len(own) % 8))
    return b"".join(parts)


class Lexicon:
    """The file at path, memory-mapped."""

    def __init__(self, path: str):
        sizes = np.fromfile(path, "<i8", len(ARRAYS))
        at = 8 * len(ARRAYS)
        for (k, kind), n in zip(ARRAYS, sizes.tolist(), strict=True):
            setattr(self, k, np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind))
            at += (n * np.dtype(kind).itemsize + 7) // 8 * 8
        self.states = len(self.final)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place among the sorted words, -1 for one that isn't there."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        found = np.full(n, -1, np.int64)
        if not len(self.edges):
            return found
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        live = np.flatnonzero(size > 0)
        state, place = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        k = 0
        while len(live):
            key = state << 8 | data[first[live] + k]
            e = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[e] == key
            live, e = live[ok], e[ok]
            state, place = self.target[e].astype(np.int64), place[ok] + self.before[e]
            k += 1
            ended = size[live] == k
            done = ended & (self.final[state] == 1)
            found[live[done]] = place[done]
            live, state, place = live[~ended], state[~ended], place[~ended]
        return found

    def outputs(self, place: int) -> np.ndarray:
        return self.ids[self.start[place] : self.start[place + 1]]
