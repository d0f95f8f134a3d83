"""Front-coded runs of sorted byte strings and their merge by a loser tree that
never compares a known common prefix again."""

from __future__ import annotations

import zlib

import numpy as np


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (diff.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> bytes:
    """Sorted strings as prefix lengths, tail lengths and tails."""
    lcps, tails, last = [], [], b""
    for s in strings:
        k = common_prefix(last, s)
        lcps.append(k)
        tails.append(s[k:])
        last = s
    head = np.array([lcps, [len(t) for t in tails]], "<u2").tobytes()
    return zlib.compress(np.int64(len(strings)).tobytes() + head + b"".join(tails), 1)


def front_decode(blob: bytes) -> tuple[list[bytes], list[int]]:
    """The strings and the common prefix of each with the one before."""
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    lcps, lens = np.frombuffer(raw, "<u2", 2 * n, 8).reshape(2, n).tolist()
    out, at, last = [], 8 + 4 * n, b""
    for k, m in zip(lcps, lens):
        last = last[:k] + raw[at:at + m]
        at += m
        out.append(last)
    return out, lcps


def merge(runs: list[tuple[list[bytes], list[int]]]):
    """Merge sorted runs; yields (run, index, common prefix with the string before).

    Every entry in the tree knows its common prefix with the last string put
    out. Of two entries the one with the longer prefix comes first; only equal
    prefixes are compared, from their end on, and the loser keeps the prefix it
    shares with the winner. A run's own prefixes come with it.
    """
    width = 1
    while width < len(runs):
        width *= 2
    strings = [r[0] for r in runs] + [[]] * (width - len(runs))
    lcps = [r[1] for r in runs] + [[]] * (width - len(runs))
    at = [0] * width
    head: list = [s[0] if s else None for s in strings]
    known = [0] * width
    loser = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); ties go to the lower run."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        k = common_prefix(x, y, ka)
        if k == len(x) and (k < len(y) or a < b) or k < len(x) and k < len(y) and x[k] < y[k]:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    winners = list(range(width))
    level = winners
    slot = width // 2
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            w, l = play(level[i], level[i + 1])
            loser[slot + i // 2] = l
            up.append(w)
        level, slot = up, slot // 2
    top = level[0]
    while head[top] is not None:
        i = at[top]
        yield top, i, known[top]
        i += 1
        at[top] = i
        if i < len(strings[top]):
            head[top], known[top] = strings[top][i], lcps[top][i]
        else:
            head[top] = None
        node = (width + top) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2
