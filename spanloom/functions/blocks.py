"""A block of verses as arrays: which of them share words, and in which order, with one verse at a time.

Plain numpy and Arrow, for Arrow batches. A word's rows lie together, so that a source meets a whole
block in a few array operations for each of its words. Sums are taken in the order of the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .pairs import EPSILON

#: Places of tokens that a walk over verses holds at a time.
CELLS = 1 << 20


def round6(x: np.ndarray) -> np.ndarray:
    return np.floor((x + EPSILON) * 1e6 + 0.5) / 1e6


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (df + 1)) + 1


def coded(lists: pa.Array) -> tuple[np.ndarray, dict[str, int]]:
    """The entries of all lists as numbers, in the order of the words, and the number of each word."""
    found = lists.flatten().dictionary_encode()
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return number[found.indices.to_numpy()], {w: k for k, w in enumerate(found.dictionary.take(pa.array(order)).to_pylist())}


class Block:
    """The verses of a batch by a layer of their tokens."""

    def __init__(self, batch: pa.RecordBatch, layer: str):
        keys = batch.column(batch.schema.get_field_index(layer))
        self.batch, self.size, self.ids = batch, len(batch), batch.column(batch.schema.get_field_index("id")).to_numpy()
        self.lengths = pc.list_value_length(keys).to_numpy().astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.codes, self.words = coded(keys)
        self.row = np.repeat(np.arange(self.size), self.lengths)
        # a posting for each word of each row, by word
        found, self.at, self.times = np.unique(self.codes * self.size + self.row, return_index=True, return_counts=True)
        self.word, self.rows = np.divmod(found, max(1, self.size))
        self.begin = np.searchsorted(self.word, np.arange(len(self.words) + 1))

    def flat(self, field: str) -> np.ndarray:
        """The entries of a list of numbers or booleans, token by token."""
        return self.batch.column(self.batch.schema.get_field_index(field)).flatten().to_numpy(zero_copy_only=False)

    def of(self, word: str) -> slice:
        """The postings of a word."""
        k = self.words.get(word)
        return slice(0, 0) if k is None else slice(self.begin[k], self.begin[k + 1])

    def totals(self, of_posting: np.ndarray) -> np.ndarray:
        """The sum over the words of each row."""
        return np.bincount(self.rows, of_posting, self.size)

    def numbered(self, words: list[str]) -> np.ndarray:
        """The numbers that the words of another verse have here; -1 for others."""
        return np.array([self.words.get(w, -1) for w in words], np.int64)

    def walk(self, rows: np.ndarray, codes: np.ndarray, weights: np.ndarray, multiplier) -> tuple[np.ndarray, ...]:
        """The alignment of a source with some rows: (pairs, distance apart, weight, weight by multiplier), as pairs.align has it.

        codes, weights: of the source's tokens. multiplier(i, places): what its token i counts with each of some tokens here.
        """
        out = [np.zeros(len(rows)) for _ in range(4)]
        step = max(1, CELLS // max(1, int(self.lengths[rows].max(initial=0))))
        for k in range(0, len(rows), step):
            for whole, part in zip(out, self._walk(rows[k : k + step], codes, weights, multiplier)):
                whole[k : k + step] = part
        return tuple(out)

    def _walk(self, rows: np.ndarray, codes: np.ndarray, weights: np.ndarray, multiplier) -> tuple[np.ndarray, ...]:
        lengths, first = self.lengths[rows], self.first[rows]
        width = int(lengths.max(initial=0))
        places = np.arange(width)
        here = np.full((len(rows), width), -2, np.int32)
        inside = places < lengths[:, None]
        here[inside] = self.codes[(first[:, None] + places)[inside]]
        n, apart, weight, case = (np.zeros(len(rows)) for _ in range(4))
        cursor, last_i, last_j = (np.zeros(len(rows), np.int64) for _ in range(3))
        span_a, span_b = max(1, len(codes) - 1), np.maximum(1, lengths - 1)
        for i, code in enumerate(codes.tolist()):
            if code < 0 or weights[i] <= 0:
                continue
            equal = here == code
            equal &= places >= cursor[:, None]
            j = equal.argmax(1)
            hit = np.flatnonzero(equal[np.arange(len(rows)), j])
            j = j[hit]
            far = np.abs((i - last_i[hit]) / span_a - (j - last_j[hit]) / span_b[hit])
            apart[hit] += np.where(n[hit] > 0, far, 0.0)
            n[hit] += 1
            weight[hit] += weights[i]
            case[hit] += weights[i] * multiplier(i, first[hit] + j)
            last_i[hit], last_j[hit], cursor[hit] = i, j, j + 1
        return n, apart, weight, case


class Grams:
    """Where each `least` tokens that follow each other in a row of a block lie."""

    def __init__(self, block: Block, least: int):
        self.block, self.least = block, least
        at, number, self.levels = np.arange(len(block.codes)), block.codes, []
        for k in range(1, least):
            if k > 1:
                self.levels.append(np.unique(number))
                number = places_in(number, self.levels[-1])
            kept = np.flatnonzero(at + k < (block.first + block.lengths)[block.row[at]])
            at, number = at[kept], number[kept]
            number = number * max(1, len(block.words)) + block.codes[at + k]
        order = np.argsort(number, kind="stable")
        self.at, number = at[order], number[order]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        self.levels.append(number[first])
        self.begin = np.append(first, len(number))

    def of(self, codes: np.ndarray) -> np.ndarray:
        """For each place of a verse from which `least` tokens go on, the gram's place among those here, or -1."""
        number = codes
        for k, known in enumerate(self.levels, 1):
            if k > 1:
                number = np.where(number >= 0, places_in(number, self.levels[k - 2]), -1)
            after = codes[k:]
            number = number[: len(after)]
            whole = np.where((number >= 0) & (after >= 0), number * max(1, len(self.block.words)) + after, -1)
            at = np.minimum(np.searchsorted(known, whole), max(0, len(known) - 1))
            number = np.where(known[at] == whole, whole, -1) if len(known) else np.full(len(whole), -1)
        return np.where(number >= 0, places_in(number, self.levels[-1]), -1)

    def places(self, gram: int) -> np.ndarray:
        """The tokens here from which a gram goes on, in order."""
        return self.at[self.begin[gram] : self.begin[gram + 1]]

    def runs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start in the verse, token here, length) of all maximal common runs of `least` tokens or more."""
        found = [(i, self.places(g)) for i, g in enumerate(self.of(codes).tolist()) if g >= 0]
        if not found:
            return (np.empty(0, np.int64),) * 3
        i = np.repeat([i for i, _ in found], [len(p) for _, p in found])
        shift = np.concatenate([p for _, p in found]) - i + len(codes)
        # one after the other on a diagonal; the next diagonal is at least two away
        chain = np.sort(shift * (len(codes) + 1) + i)
        begins = np.flatnonzero(np.diff(chain, prepend=-2) != 1)
        n = np.diff(begins, append=len(chain)) + self.least - 1
        shift, i = np.divmod(chain[begins], len(codes) + 1)
        return i, shift - len(codes) + i, n


def places_in(numbers: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Numbers as places in a sorted array of those that are known, so that products of them stay small."""
    return np.searchsorted(known, numbers)
