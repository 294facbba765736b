"""Common prefixes of suffixes by interval expansion on a Burrows-Wheeler transform, bounded by a threshold.

For a handful of byte strings of bounded total size, inside one task. Suffixes are put in order by
prefix doubling, only as deep as the threshold. The transform gives, for each row, the row of the suffix one
byte longer to the left. From the intervals of the first few bytes on, all intervals of one length are extended
backward together (breadth first), so boundaries between rows get their common prefix by increasing
value; at the threshold the walk stops, and rows that no boundary separates share that many bytes.
"""

from __future__ import annotations

import numpy as np

# Nine-bit symbols in a 64-bit key: 0 ends a string, 1 to 256 are bytes.
SYMBOLS = 7
# Bytes in common from which intervals are extended.
SEED = 2 * SYMBOLS


def ordered_pairs(high, low, bits: int):
    """The order of pairs of numbers of so many ``bits``, and which of them, but the first, differ from the one before.

    Keys that have room for their place, too, are sorted themselves, which is several times faster than finding their order.
    """
    if 3 * bits < 64:
        keys = (high << 2 * bits) | (low.astype(np.int64) << bits) | np.arange(len(high))
        keys.sort()
        return keys & ((1 << bits) - 1), np.diff(keys >> bits) != 0
    keys = (high << 32) | low
    sorting = np.argsort(keys)
    return sorting, np.diff(keys[sorting]) != 0


def suffix_order(strings: list[bytes], depth: int):
    """Rows of all suffixes in order to ``depth`` bytes, and the classes of rows with ``SEED`` bytes in common.

    Returns ``(text, order, first, young, left)``: symbols by position, positions by row, which rows, and one beyond, open
    a class, the rows among them that have all but the last of these bytes in common with the row before, and how
    many bytes are left in its string by position. Ends of strings are positions too, and differ from each other.
    """
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    text = np.zeros(n + SYMBOLS, np.int64)
    text[:n] = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    text[:n] += 1
    text[ends] = 0
    left = np.repeat(ends, sizes + 1) - np.arange(n)
    two = (text[:-1] << 9) | text[1:]
    key = (two[:n] << 45) | (two[2 : n + 2] << 27) | (two[4 : n + 4] << 9) | text[6 : n + 6]
    for k in range(SYMBOLS):
        # Nothing behind the end of the string counts.
        at, unused = ends[sizes >= k] - k, 9 * (SYMBOLS - k)
        key[at] = key[at] >> unused << unused
    order = np.argsort(key)
    ordered = key[order]
    short = ordered & 511 == 0
    first = np.ones(n + 1, bool)
    first[1:n] = (ordered[1:] != ordered[:-1]) | short[1:] | short[:-1]
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = np.maximum.accumulate(np.where(first[:n], np.arange(n), 0))
    reached = SYMBOLS
    while reached < max(depth, SEED):
        # A row that is a class of its own stays where it is.
        rows = np.flatnonzero(~(first[:n] & first[1:]))
        new = np.empty(0, np.int64)
        if len(rows):
            at = order[rows]
            sorting, edges = ordered_pairs(np.maximum.accumulate(np.where(first[rows], rows, 0)), rank[at + reached], n.bit_length())
            order[rows] = at = at[sorting]
            new = rows[1:][edges & ~first[rows[1:]]]
            first[new] = True
            rank[at] = np.maximum.accumulate(np.where(first[rows], rows, 0))
        reached *= 2
        if reached == SEED:
            # Neighbours are alike in the first half here; in the second, all but the last symbol must be equal bytes.
            above, below = (key[order[x] + SYMBOLS] >> 9 for x in (new - 1, new))
            seeds, young = first.copy(), new[(above == below) & (above & 511 > 0)]
    return text[:n].astype(np.int16), order, seeds, young, left


def shared_classes(text, order, first, young, left, threshold: int):
    """Flags of the rows, and one beyond, that begin a class of suffixes with ``threshold`` bytes in common."""
    n = len(order)
    # The transform as a map: the row of the suffix one byte longer, or -1 where a string begins.
    before = np.empty(n + 1, np.int64)
    before[order + 1] = np.arange(n)
    before[np.flatnonzero(left == 0) + 1] = before[0] = -1
    previous, bytes_of = before[order], text[order]
    known = first.copy()
    # Intervals that end at a boundary of less value are extended already: their extensions end where shorter ones' do.
    opening = np.flatnonzero(known[:n])
    low, high = opening[np.searchsorted(opening, young) - 1], young - 1
    for _ in range(SEED, threshold):
        if not len(low):
            break
        # All extensions of the intervals by one byte to the left: rows of one interval and one byte lie together.
        sizes = high - low + 1
        upto = np.cumsum(sizes)
        target = previous[np.repeat(low - (upto - sizes), sizes) + np.arange(upto[-1])]
        # Sorted by target, with the interval in the lower half; those that begin a string come first.
        pair = (target << 32) | np.repeat(np.arange(len(low)), sizes)
        pair.sort()
        pair = pair[np.searchsorted(pair, 0) :]
        if not len(pair):
            break
        group, target = pair.astype(np.int32), pair >> 32
        byte = bytes_of[target]
        edges = np.flatnonzero((group[1:] != group[:-1]) | (byte[1:] != byte[:-1]))
        low, high = target[np.append(0, edges + 1)], target[np.append(edges, len(target) - 1)]
        # A boundary seen for the first time has this value; one seen before ends the search there.
        new = ~known[high + 1]
        low, high = low[new], high[new]
        known[high + 1] = True
    return known


def repeated_starts(strings: list[bytes], weights, threshold: int) -> list[np.ndarray]:
    """For each string, where the substrings of ``threshold`` bytes begin that begin anywhere else too.

    A string of weight two or more stands for so many copies, whose substrings are elsewhere as well.
    """
    if threshold <= SEED:
        raise ValueError(f"the threshold must be over {SEED} bytes")
    text, order, first, young, left = suffix_order(strings, threshold)
    first = shared_classes(text, order, first, young, left, threshold)
    sizes = np.array([len(s) for s in strings])
    weight = np.repeat(np.asarray(weights, np.int64), sizes + 1)
    # A class has all of its rows among these, or it is a shorter suffix alone.
    rows = np.flatnonzero(left[order] >= threshold)
    marked = np.zeros(len(order), bool)
    if len(rows):
        at, edges = order[rows], np.flatnonzero(first[rows])
        total = np.add.reduceat(weight[at], edges)
        marked[at[np.repeat(total > 1, np.diff(np.append(edges, len(rows))))]] = True
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    return [np.flatnonzero(marked[a:b]) for a, b in zip(bounds, bounds[1:])]
