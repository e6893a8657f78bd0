"""Similarity of many pairs of short strings at once, as array arithmetic.

Strings are rows of code points, padded at the end. The work on a pair only depends on the
pair, so pairs are handled in slices of bounded size, ordered by length.
"""

import numpy as np

CELLS = 1 << 16  # array cells of one slice, few enough for the processor's caches
NOTHING, OUTSIDE = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)  # no code points
# --- fixed values ---------------------------------------------------------
POPULAR_LENGTH = 200
POPULAR_SHARE = 100
# --------------------------------------------------------------------------


def code_points(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Padded code points (n, longest) and lengths."""
    sizes = np.array([len(v) for v in values], np.int64)
    flat = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(values), int(sizes.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _popular(b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of long second strings whose character is too common to start a block."""
    out = np.zeros(b.shape, bool)
    for row in np.flatnonzero(size >= POPULAR_LENGTH):
        own = b[row, : size[row]]
        _, back, counts = np.unique(own, return_inverse=True, return_counts=True)
        out[row, : size[row]] = (counts > size[row] // POPULAR_SHARE + 1)[back]
    return out


def _longest_blocks(a, b, common, pair, alo, ahi, blo, bhi):
    """Begin in both strings and length of the longest common block of each window, the first one in a, then in b."""
    n, width = len(pair), int((bhi - blo).max(initial=0))
    size, at_a, at_b = np.zeros(n, np.int64), alo.copy(), blo.copy()
    # Windows are lined up at their begin; a place outside a window, or one that starts no block, equals nothing.
    place = blo[:, None] + np.arange(width)
    right = b[pair[:, None], np.minimum(place, b.shape[1] - 1)]
    right[(place >= bhi[:, None]) | common[pair[:, None], np.minimum(place, b.shape[1] - 1)]] = NOTHING
    run = np.zeros((n, width + 1), np.int32)  # run[:, j + 1]: length of the block that ends at j
    each = np.arange(n)
    for step in range(int((ahi - alo).max(initial=0))):
        i = alo + step
        here = np.where(i < ahi, a[pair, np.minimum(i, a.shape[1] - 1)], OUTSIDE)
        run[:, 1:] = (run[:, :-1] + 1) * (right == here[:, None])
        top = run[:, 1:].argmax(axis=1)
        best = run[each, top + 1]
        better = np.flatnonzero(best > size)
        found = best[better]
        size[better], at_a[better], at_b[better] = found, i[better] - found + 1, blo[better] + top[better] - found + 1
    # A block may go on over characters that could not start it.
    grow = common[pair].any(axis=1) if common.any() else np.zeros(n, bool)
    while grow.any():
        left = grow & (at_a > alo) & (at_b > blo)
        left[left] = a[pair[left], at_a[left] - 1] == b[pair[left], at_b[left] - 1]
        at_a[left], at_b[left], size[left] = at_a[left] - 1, at_b[left] - 1, size[left] + 1
        after = ~left & grow & (at_a + size < ahi) & (at_b + size < bhi)
        after[after] = a[pair[after], (at_a + size)[after]] == b[pair[after], (at_b + size)[after]]
        size[after] += 1
        grow = left | after
    return at_a, at_b, size


def _matched(a, a_size, b, b_size) -> np.ndarray:
    """Characters in matching blocks: the longest block, then the same on both of its sides."""
    total = np.zeros(len(a), np.int64)
    common = _popular(b, b_size)
    pair = np.flatnonzero((a_size > 0) & (b_size > 0))
    alo, ahi, blo, bhi = np.zeros(len(pair), np.int64), a_size[pair], np.zeros(len(pair), np.int64), b_size[pair]
    while len(pair):
        i, j, k = _longest_blocks(a, b, common, pair, alo, ahi, blo, bhi)
        np.add.at(total, pair, k)
        before = (k > 0) & (alo < i) & (blo < j)
        behind = (k > 0) & (i + k < ahi) & (j + k < bhi)
        pair, alo, ahi, blo, bhi = (
            np.concatenate([x[before], y[behind]]) for x, y in ((pair, pair), (alo, i + k), (i, ahi), (blo, j + k), (j, bhi))
        )
    return total


def _edits(a, a_size, b, b_size) -> np.ndarray:
    """Edit distances; the running minimum along a row replaces its step by step dependence."""
    places = np.arange(b.shape[1] + 1)
    row = np.tile(places, (len(a), 1))
    out = np.where(a_size == 0, b_size, 0)
    for i in range(a.shape[1]):
        step = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]))
        row = np.minimum.accumulate(np.concatenate([np.full((len(a), 1), i + 1), step], axis=1) - places, axis=1) + places
        done = a_size == i + 1
        out[done] = row[done, b_size[done]]
    return out


def pair_similarity(a: list[str], b: list[str], metric: str = "ratio") -> np.ndarray:
    """Similarity of each ``a[i]`` to ``b[i]`` in [0, 1]; two empty strings are equal.

    ``ratio`` is twice the characters in matching blocks over both lengths and depends on the order of the arguments;
    in second strings of 200 characters or more, very frequent characters start no block. ``levenshtein`` is
    one less the edit distance over the longer length.
    """
    if metric not in ("ratio", "levenshtein"):
        raise ValueError(f"unknown metric {metric!r}")
    out = np.ones(len(a))
    longest = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    order = np.argsort(longest, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * (longest[order[stop]] + 1) <= CELLS:
            stop = min(len(order), stop + max(1, (stop - start) // 2))
            if (stop - start) * (longest[order[stop - 1]] + 1) > CELLS:
                stop = start + max(1, int(CELLS // (longest[order[stop - 1]] + 1)))
                break
        part = order[start:stop]
        left, left_size = code_points([a[k] for k in part])
        right, right_size = code_points([b[k] for k in part])
        if metric == "ratio":
            both = left_size + right_size
            value = np.where(both > 0, 2.0 * _matched(left, left_size, right, right_size) / np.maximum(1, both), 1.0)
        else:
            most = np.maximum(left_size, right_size)
            value = np.where(most > 0, 1.0 - _edits(left, left_size, right, right_size) / np.maximum(1, most), 1.0)
        out[part] = value
        start = stop
    return out
