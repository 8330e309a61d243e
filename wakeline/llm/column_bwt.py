"""Column-wise construction of a collection's Burrows-Wheeler transform.

The texts of a collection are inserted from the right, one symbol of every text in each
round.  A round is one sequential pass: the symbols are written at the places of the
suffixes they precede, the ranks of equal symbols give the places of the new suffixes, and
old and new entries are merged into the next list.  A pass carries the transform alone, a byte
a symbol; where each suffix begins is read off the whole transform in the end, by following
the ranks from the empty suffixes, and so is the prefix (``depth`` bytes) that it shares with
the suffix before it.
"""

from __future__ import annotations

import numpy as np


#: Neighbours compared at once.
AT_ONCE = 1 << 14


def _shared(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether suffixes at ``a`` and ``b``, both ``depth`` long at least, share that prefix."""
    same = np.ones(len(a), bool)
    # most neighbours differ early; only pairs still equal are read on
    for first in range(0, depth, 20):
        left = np.flatnonzero(same)
        if len(left) == 0:
            break
        span = np.arange(first, min(first + 20, depth))
        same[left] = (data[a[left, None] + span] == data[b[left, None] + span]).all(axis=1)
    return same


def _ranks(bwt: np.ndarray) -> np.ndarray:
    """Place of each entry among all in order of symbol and place."""
    rank = np.empty(len(bwt), np.int32)
    rank[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
    return rank


def column_wise(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the texts ``data[starts[i]:ends[i]]`` in order.

    Returns the transform (symbol + 1, 0 where a text begins), where each suffix begins, and
    whether it shares ``depth`` bytes with the suffix before it.  The first entries are the
    empty suffixes, one a text.  No UTF-8 byte exceeds 0xF4, so symbols + 1 fit a byte.
    """
    m = len(starts)
    length = ends - starts
    rounds = int(length.max()) if m else 0
    bwt = np.zeros(m, np.uint8)
    place = np.arange(m)  # where the last suffix of each unfinished text stands
    for done in range(rounds):
        active = np.flatnonzero(length > done)
        bwt[place[active]] = data[ends[active] - done - 1] + 1
        # the entries of finished texts have no symbol, come first and have no new suffix
        place[active] = new = _ranks(bwt)[place[active]] + len(active)
        kept = np.ones(len(bwt) + len(active), bool)
        kept[new] = False
        out = np.zeros(len(kept), np.uint8)
        out[kept] = bwt
        bwt = out
    # in the whole transform the rank of a symbol is the place of the suffix that it begins
    rank, place = _ranks(bwt), np.arange(m)
    at = np.empty(len(bwt), np.int64)
    at[:m] = ends
    long = np.zeros(len(bwt), bool)  # suffixes of depth symbols or more
    for done in range(rounds):
        active = np.flatnonzero(length > done)
        place[active] = new = rank[place[active]]
        at[new] = ends[active] - done - 1
        long[new] = done + 1 >= depth
    shares = np.zeros(len(bwt), bool)
    both = np.flatnonzero(long[1:] & long[:-1]) + 1
    for first in range(0, len(both), AT_ONCE):
        k = both[first: first + AT_ONCE]
        shares[k] = _shared(data, at[k - 1], at[k], depth)
    return bwt, at, shares
