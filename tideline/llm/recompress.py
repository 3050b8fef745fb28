"""Locally consistent parsing of token sequences by recompression, in numpy.

A round names runs of equal symbols, or pairs of a left and a right symbol (the side of a symbol is a bit of its name). Names are
64-bit fingerprints of what they stand for, so the same run or pair gets the same name in every document and task,
without a dictionary. Equal stretches therefore get equal symbols, but for some near their ends: with each symbol goes the
range of tokens that settles it (its context). Where the context lies inside a window, every copy of the window has that
symbol in the same place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix

ROUNDS = "RPP"
FAR = 1 << 40
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Symbols:
    """name; tokens [start, end); context [low, high); doc: the index of the document that holds it."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray


def tokens(name: np.ndarray, doc: np.ndarray) -> Symbols:
    at = np.arange(len(name))
    return Symbols(name, at, at + 1, at, at + 1, doc)


def runs(x: Symbols, salt: int) -> Symbols:
    """Names each maximal run of equal symbols. That a run ends is settled by its two neighbours."""
    n = len(x.name)
    first = np.flatnonzero(np.concatenate(([True], (x.name[1:] != x.name[:-1]) | (x.doc[1:] != x.doc[:-1]))))
    last = np.append(first[1:], n) - 1
    size = last - first + 1
    name = x.name[first]
    many = size > 1
    name[many] = mix(name[many] * A + size[many].astype(np.uint64) * B + np.uint64(salt))
    low, high = np.minimum.reduceat(x.low, first), np.maximum.reduceat(x.high, first)
    doc = x.doc[first]
    inner = doc[1:] == doc[:-1]
    left_low, left_high = np.full(len(first), -FAR), np.full(len(first), -FAR)
    left_low[1:][inner], left_high[1:][inner] = x.low[last[:-1]][inner], x.high[last[:-1]][inner]
    right_low, right_high = np.full(len(first), FAR), np.full(len(first), FAR)
    right_low[:-1][inner], right_high[:-1][inner] = x.low[first[1:]][inner], x.high[first[1:]][inner]
    low = np.minimum(np.minimum(low, left_low), right_low)
    high = np.maximum(np.maximum(high, left_high), right_high)
    return Symbols(name, x.start[first], x.end[last], low, high, doc)


def pairs(x: Symbols, salt: int) -> Symbols:
    """Names each left symbol with the right symbol behind it. That a symbol stays alone is settled by one neighbour."""
    n = len(x.name)
    right = (mix(x.name + np.uint64(salt)) >> np.uint64(63)).astype(bool)
    joins = np.zeros(n, bool)
    joins[:-1] = ~right[:-1] & right[1:] & (x.doc[1:] == x.doc[:-1])
    second = np.zeros(n, bool)
    second[1:] = joins[:-1]
    keep = np.flatnonzero(~second)
    two = joins[keep]
    side = np.where(right[keep] & ~two, -1, 1)
    near = keep + side
    same = (near >= 0) & (near < n)
    near = np.clip(near, 0, n - 1)
    same &= x.doc[near] == x.doc[keep]
    low = np.where(same, np.minimum(x.low[keep], x.low[near]), np.where(side < 0, -FAR, x.low[keep]))
    high = np.where(same, np.maximum(x.high[keep], x.high[near]), np.where(side > 0, FAR, x.high[keep]))
    name, end = x.name[keep], x.end[keep]
    k = keep[two]
    name[two] = mix(x.name[k] * A + x.name[k + 1] * B + np.uint64(salt + 1))
    end[two] = x.end[k + 1]
    return Symbols(name, x.start[keep], end, low, high, x.doc[keep])


def levels(name: np.ndarray, doc: np.ndarray, rounds: str = ROUNDS) -> list[Symbols]:
    """The token level and the level after each round."""
    out = [tokens(name, doc)]
    for k, kind in enumerate(rounds):
        out.append((runs if kind == "R" else pairs)(out[-1], 1000 * (k + 1)))
    return out


def anchors(found: list[Symbols], window: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name and token position of the anchor of each window that starts at a token.

    The anchor is a symbol whose context the window holds: of the highest level at which there is one, the one with the
    smallest hash, then the leftmost. It depends on the window's tokens alone; a token is its own context, so there always is
    one. whole: the windows that end within their document; the others get position -1.
    """
    n = len(whole)
    name, at, todo, none = np.zeros(n, np.uint64), np.full(n, -1), whole.copy(), np.iinfo(np.uint64).max
    for level in range(len(found) - 1, -1, -1):
        x = found[level]
        waiting = np.concatenate(([0], np.cumsum(todo)))
        if not waiting[-1]:
            break
        fits = x.high - x.low <= window
        first, last = np.clip(x.high - window, 0, n), np.clip(x.low + 1, 0, n)
        some = np.flatnonzero(fits & (waiting[last] > waiting[np.minimum(first, last)]))
        rank = (mix(x.name[some] ^ np.uint64(7777 + level)) >> np.uint64(24)) << np.uint64(5)
        low, start, spare = x.low[some], x.start[some], window - (x.high - x.low)[some]
        best = np.full(n, none, np.uint64)
        for t in range(window):
            if t:
                ok = np.flatnonzero((spare >= t) & (low >= t))
                rank, spare, low, start = rank[ok], spare[ok], low[ok], start[ok]
                if not len(rank):
                    break
            np.minimum.at(best, low - t, rank | (start - low + t).astype(np.uint64))
        got = np.flatnonzero(todo & (best != none))
        pos = got + (best[got] & np.uint64(31)).astype(np.int64)
        by_start = np.zeros(n, np.uint64)
        by_start[x.start] = x.name
        name[got], at[got] = mix(by_start[pos] ^ np.uint64(level)), pos
        todo[got] = False
    return name, at


def joined(x: np.ndarray, y: np.ndarray, gap: int) -> np.ndarray:
    """Names of x from each position with y from ``gap`` positions on (meaningless where that is beyond the end)."""
    out = x * A
    if gap < len(out):
        out[: len(out) - gap] += y[gap:] * B
    return mix(out)


def stretch_names(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the 10 and of the 20 tokens from each position, by doubling."""
    s2 = joined(name, name, 1)
    s4 = joined(s2, s2, 2)
    s8 = joined(s4, s4, 4)
    s16 = joined(s8, s8, 8)
    return joined(s8, s2, 8), joined(s16, s4, 16)
