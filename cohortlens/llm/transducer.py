"""A minimal acyclic transducer over bytes, from words to lists of ids, in memory-mapped arrays.

Words are added in sorted order and states with equal futures are shared (incremental minimisation). Each transition
carries the number of words that sort before its branch, so the sum along a path is the word's number, which leads to its
ids. Transitions lie in an open-addressing table, so that many words are walked at once in NumPy.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

import numpy as np

_MULTIPLIER = np.uint32(2654435761)


def _minimal(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """(transitions of each state, is it final) of the minimal automaton of sorted distinct words; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states of the word added last
    last = b""

    def settle(depth: int) -> None:
        for k in range(len(path) - 1, depth, -1):
            state, parent = path[k], path[k - 1]
            key = (final[state], *edges[state].items())
            same = register.setdefault(key, state)
            if same != state:
                edges[parent][last[k - 1]] = same
                edges[state] = {}
        del path[depth + 1 :]

    for word in words:
        shared = 0
        for a, b in zip(word, last, strict=False):
            if a != b:
                break
            shared += 1
        settle(shared)
        for byte in word[shared:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][byte] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    return edges, final


class Transducer:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.keys, self.next, self.skip, self.final, self.starts, self.ids = (arrays[k] for k in ("keys", "next", "skip", "final", "starts", "ids"))
        self.shift = np.uint32(32 - (len(self.keys).bit_length() - 1))

    @classmethod
    def build(cls, words: Iterable[tuple[bytes, list[int]]]) -> Transducer:
        entries = sorted(dict(words).items())
        edges, final = _minimal([w for w, _ in entries])
        order, seen, stack = [], set(), [(0, False)]
        while stack:  # children before parents
            state, done = stack.pop()
            if done:
                order.append(state)
            elif state not in seen:
                seen.add(state)
                stack.append((state, True))
                stack.extend((t, False) for t in edges[state].values() if t not in seen)
        number = {s: k for k, s in enumerate(reversed(order))}
        count: dict[int, int] = {}
        keys, targets, skips = [], [], []
        for state in order:
            total = int(final[state])
            for byte in sorted(edges[state]):
                target = edges[state][byte]
                keys.append(number[state] << 8 | byte)
                targets.append(number[target])
                skips.append(total)
                total += count[target]
            count[state] = total
        size = 1 << max(4, (2 * len(keys)).bit_length())
        table = {"keys": np.full(size, 0xFFFFFFFF, dtype=np.uint32), "next": np.zeros(size, dtype=np.uint32), "skip": np.zeros(size, dtype=np.uint32)}
        left_keys, left_next, left_skip = (np.array(x, dtype=np.uint32) for x in (keys, targets, skips))
        slot = (left_keys * _MULTIPLIER) >> np.uint32(32 - (size.bit_length() - 1))
        while len(left_keys):
            free = table["keys"][slot] == 0xFFFFFFFF
            first = np.zeros(len(slot), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            placed = free & first
            for name, values in (("keys", left_keys), ("next", left_next), ("skip", left_skip)):
                table[name][slot[placed]] = values[placed]
            rest = ~placed
            left_keys, left_next, left_skip, slot = left_keys[rest], left_next[rest], left_skip[rest], (slot[rest] + np.uint32(1)) & np.uint32(size - 1)
        table["final"] = np.array([final[s] for s in reversed(order)], dtype=np.uint8)
        table["starts"] = np.cumsum([0, *[len(ids) for _, ids in entries]]).astype(np.int64)
        table["ids"] = np.array([i for _, ids in entries for i in ids], dtype=np.uint32)
        return cls(table)

    def payload(self) -> bytes:
        """A line of JSON that says where each array lies, then the arrays."""
        head, at = {}, 0
        for name, a in self.arrays.items():
            head[name] = (a.dtype.str, len(a), at)
            at += -(-a.nbytes // 64) * 64
        line = json.dumps(head).encode()
        line += b" " * (-(len(line) + 1) % 64) + b"\n"
        return line + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 64) for a in self.arrays.values())

    def write(self, path: str) -> None:
        Path(path).write_bytes(self.payload())

    @classmethod
    def map(cls, path: str) -> Transducer:
        """Map a written file; its pages are shared by all processes of a machine."""
        with Path(path).open("rb") as f:
            line = f.readline()
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        return cls({name: raw[len(line) + at : len(line) + at + np.dtype(kind).itemsize * n].view(kind) for name, (kind, n, at) in json.loads(line).items()})

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word data[start:end], or -1 if the automaton doesn't accept it."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.ids):
            return out
        who = np.arange(len(starts))
        at = starts.copy()
        state = np.zeros(len(starts), dtype=np.uint32)
        number = np.zeros(len(starts), dtype=np.int64)
        mask = np.uint32(len(self.keys) - 1)
        while len(who):
            over = at == ends[who]
            if over.any():
                done = over & (self.final[state] == 1)
                out[who[done]] = number[done]
                keep = ~over
                who, at, state, number = who[keep], at[keep], state[keep], number[keep]
                if not len(who):
                    break
            key = (state << np.uint32(8)) | data[at]
            slot = (key * _MULTIPLIER) >> self.shift
            found = self.keys[slot]
            lost = np.flatnonzero((found != key) & (found != 0xFFFFFFFF))
            while len(lost):
                slot[lost] = (slot[lost] + np.uint32(1)) & mask
                found[lost] = self.keys[slot[lost]]
                lost = lost[(found[lost] != key[lost]) & (found[lost] != 0xFFFFFFFF)]
            keep = found == key
            if keep.all():
                number += self.skip[slot]
                state = self.next[slot]
                at += 1
            else:
                slot = slot[keep]
                who, at, number, state = who[keep], at[keep] + 1, number[keep] + self.skip[slot], self.next[slot]
        return out
