"""Hashes of words, lines and byte windows of many texts at once, in numpy.

Texts of a block are joined by line feeds; spans of the joined bytes get 64-bit polynomial hashes, finished
by a mixer. Everything here runs inside tasks on blocks of bounded size.
"""

from __future__ import annotations

import numpy as np

# A random odd base of the polynomials, and the constants of the splitmix64 finisher.
BASE = 0x9E3779B97F4A7C15 | 1
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_powers = [np.ones(1, np.uint64)]


def powers(count: int) -> np.ndarray:
    """The first ``count`` powers of the base, modulo 2^64."""
    if len(_powers[0]) < count:
        size = max(count, 2 * len(_powers[0]), 1 << 12)
        with np.errstate(over="ignore"):
            steps = np.full(size, BASE, np.uint64)
            steps[0] = 1
            _powers[0] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:count]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
        return x ^ (x >> np.uint64(31))


def lut(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


BLANKS = lut(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, a line feed after each, and where each text starts (and the end of all)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8), starts


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def span_hashes(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each of the spans, none empty, that ``values`` falls into one after another."""
    if not len(lengths):
        return np.empty(0, np.uint64)
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(len(values)) - np.repeat(offsets, lengths)
    with np.errstate(over="ignore"):
        terms = (values.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
        sums = np.add.reduceat(terms, offsets)
        return mixed(sums + lengths.astype(np.uint64) * np.uint64(MIX[1]))


def words(texts: list[bytes], lower: bool = False):
    """Hashes of all words of the texts in order, and how many words each text has."""
    data, starts = joined(texts)
    if lower:
        data = LOWER[data]
    inside = ~BLANKS[data]
    begins, ends = runs(inside)
    counts = np.diff(np.searchsorted(begins, starts))
    return span_hashes(data[inside], ends - begins), counts


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the window of ``size`` words that starts at each word; those at the end are of no use."""
    with np.errstate(over="ignore"):
        scaled = [hashes * powers(size + 1)[k + 1] for k in range(size)]
        sums = np.zeros(len(hashes), np.uint64)
        for k in range(size):
            sums[: len(sums) - k] += scaled[k][k:]
    return mixed(sums)


def shingles(texts: list[bytes], size: int, lower: bool = True) -> list[np.ndarray]:
    """The distinct hashes of each text's word windows of ``size``, sorted.

    A text with fewer words, but one at least, has its whole sequence as its one window.
    """
    return [found for found, _ in weighed_shingles(*words(texts, lower), size)]


def weighed_shingles(hashes: np.ndarray, counts: np.ndarray, size: int, weights: np.ndarray | None = None):
    """Of each text, given its word hashes and their number, the `shingles` and the sum of their words' ``weights``.

    Weights go by the word's hash modulo their number; a window has the same sum wherever it stands, and one shorter than ``size`` none.
    """
    of_window, total = windows(hashes, size), np.zeros(len(hashes))
    if weights is not None:
        of_word = weights[(hashes % np.uint64(len(weights))).astype(np.int64)]
        for k in range(size):
            total[: len(total) - k] += of_word[k:]
    found, end = [], 0
    for count in counts.tolist():
        begin, end = end, end + count
        if count >= size:
            distinct, first = np.unique(of_window[begin : end - size + 1], return_index=True)
            found.append((distinct, total[begin:end][first]))
        elif count:
            found.append((span_hashes(hashes[begin:end], np.array([count])), np.zeros(1)))
        else:
            found.append((np.empty(0, np.uint64), np.empty(0)))
    return found


def inverse_powers(count: int) -> np.ndarray:
    """The first ``count`` powers of the base's inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        steps = np.full(max(count, 1), pow(BASE, -1, 1 << 64), np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)


class Lines:
    """Lines of a block of texts as sequences of word hashes.

    ``of``: the text of each line; ``place``: its number in the text; ``size``: its words. Lines end at line
    feeds, and white space between words does not count.
    """

    def __init__(self, texts: list[bytes]):
        data, starts = joined(texts)
        feeds = np.flatnonzero(data == 10)
        self.of = np.searchsorted(starts, feeds, "right") - 1
        first = np.searchsorted(feeds, starts[:-1])
        self.place = np.arange(len(feeds)) - first[self.of] if len(feeds) else np.empty(0, np.int64)
        begins, ends = runs(~BLANKS[data])
        self.words = span_hashes(data[~BLANKS[data]], ends - begins)
        self.size = np.bincount(np.searchsorted(feeds, begins), minlength=len(feeds))
        self.start = np.cumsum(self.size) - self.size
        index = np.arange(len(self.words)) - np.repeat(self.start, self.size)
        longest = int(self.size.max(initial=0)) + 2
        self.inverse = inverse_powers(longest)
        self.sums = [self.prefix_sums(w, powers(longest)[index + 1]) for w in (self.words, mixed(self.words ^ np.uint64(MIX[0])))]

    @staticmethod
    def prefix_sums(hashes, scale) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * scale, dtype=np.uint64)])

    @staticmethod
    def finished(sums: np.ndarray, sizes: np.ndarray, salt: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(sums + sizes.astype(np.uint64) * np.uint64(MIX[1]) + np.uint64(salt))

    def part(self, begin: np.ndarray, count: np.ndarray, stream: int = 0) -> np.ndarray:
        """Sums of the words of each line from its ``begin`` on, as if they stood at its start."""
        sums, at = self.sums[stream], self.start + begin
        with np.errstate(over="ignore"):
            return (sums[at + count] - sums[at]) * self.inverse[begin]

    def keys(self, stream: int = 0) -> np.ndarray:
        return self.finished(self.part(np.zeros_like(self.size), self.size, stream), self.size)

    def halves(self) -> np.ndarray:
        """Four keys per line; lines one word edit apart have one in common.

        Of two such lines, the longer with M words, the first or the last (M - 1) // 2 words are equal. A line is the longer one or
        has a word less.
        """
        found = []
        for longer in (self.size, self.size + 1):
            half = np.minimum(np.maximum(longer - 1, 0) // 2, self.size)
            for side, begin in enumerate((np.zeros_like(half), self.size - half)):
                found.append(self.finished(self.part(begin, half), longer, side + 1))
        return np.stack(found, axis=1) if len(self.size) else np.empty((0, 4), np.uint64)

    def without_each(self, line: int) -> np.ndarray:
        """Keys of the line's deletion neighbours: without its first word, its second, and so on."""
        size, start, sums = int(self.size[line]), int(self.start[line]), self.sums[0]
        at = start + np.arange(size)
        with np.errstate(over="ignore"):
            raw = (sums[at] - sums[start]) + (sums[start + size] - sums[at + 1]) * self.inverse[1]
        return self.finished(raw, np.full(size, size - 1))
