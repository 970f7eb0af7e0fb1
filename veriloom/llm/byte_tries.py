"""Radix tries of byte strings in numpy, many strings at once."""

from __future__ import annotations

import numpy as np

#: Levels by which a trie branches, seven bytes each. Below them an edge holds the whole rest of a string.
LEVELS = 8


def leaf_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each term, numbered in UTF-8 order, and a term of each leaf.

    A level of the trie at a time, for all terms at once. A node is known by the number of terms before it, which its
    children refine. Seven bytes make a branch, zeros past a term's end, then how many bytes are left (8 for more than
    seven), so that they compare as the bytes do. A node with a single term is a leaf whose edge holds the rest.
    """
    node, open_ = np.zeros(len(starts), np.int64), np.arange(len(starts))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for level in range(LEVELS + 1):
        if not len(open_):
            break
        at, last = starts[open_] + 7 * level, ends[open_]
        if level < LEVELS:
            eight = padded[at[:, None] + np.arange(8)]
            left = np.minimum(last - at, 8)
            eight[np.arange(8) >= left[:, None]] = 0
            eight[:, 7] = left
            branch = eight.view(">u8")[:, 0].astype(np.uint64)
        else:
            rests = [data[a:b].tobytes() for a, b in zip(at, last, strict=True)]
            ranks = {r: k for k, r in enumerate(sorted(set(rests)))}
            branch = np.array([ranks[r] for r in rests], np.uint64)
        parent = node[open_]
        order = np.lexsort((branch, parent)) if level else np.argsort(branch, kind="stable")
        parent, branch = parent[order], branch[order]
        new_parent = np.diff(parent, prepend=-1) != 0
        new = new_parent.copy()
        new[1:] |= branch[1:] != branch[:-1]
        first, begun = np.flatnonzero(new), np.flatnonzero(new_parent)
        which = np.cumsum(new) - 1
        node[open_[order]] = parent + first[which] - begun[np.cumsum(new_parent) - 1]
        size = np.diff(first, append=len(order))
        open_ = open_[order][(size[which] > 1) & (branch & np.uint64(15) == 8)] if level < LEVELS else open_[:0]
    _, one, leaf = np.unique(node, return_index=True, return_inverse=True)
    return leaf, one


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and each array's sums over them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these ranges one after another, and where each begins and the last ends."""
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return data[np.repeat(starts - bounds[:-1], lengths) + np.arange(bounds[-1])], bounds
