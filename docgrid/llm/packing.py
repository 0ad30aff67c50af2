"""Packing of tokenised documents into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import PATTERN, Bpe, bpe
from .common import freed, frugal, ids_of, keyed, small_batches

WINDOW = 1024
#: Longest piece of a document that a window shares with other pieces: with four or more pieces a window, differencing comes out near-equal.
CUT = 256
#: Windows that one differencing deals pieces to, and the pieces it may get: what it holds grows with their product.
WAYS, MOST_PIECES = 64, 2048
#: Free tokens that a full set leaves each of its windows, on the average.
SLACK = 2
#: Rows that a task hands on at once.
ROWS = 8192


@lru_cache(maxsize=2)
def _fast(path: str) -> tiktoken.Encoding:
    """An encoder with the vocabulary of a tokenizer file."""
    own = Bpe(path)
    special = dict(own.added)
    ranks = {b: i for i, b in own.bytes_of.items() if i not in special.values()}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, path: str, end_id: int = 0) -> np.ndarray:
    """Token ids of a text with the end id after them."""
    try:
        ids = _fast(path).encode(text, allowed_special="all")
    except Exception:  # the library's pattern engine refuses some very long runs
        ids = bpe(path).encode(text)
    return np.array([*ids, end_id], dtype="<u4")


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp in `ways` parts: item numbers of each part.

    A partial partition is a row of parts, largest sum first, measured from its
    smallest.  The two partial partitions of the largest spread are merged with
    opposing imbalances (largest part with smallest) until one is left.
    """
    if ways <= 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(ways - 1)]
    heap = []
    for i, s in enumerate(sizes):
        sums, node = np.zeros(ways, dtype=np.int64), np.full(ways, -1, dtype=np.int64)
        sums[0], node[0] = s, i
        heap.append((-s, i, sums, node))
    heapq.heapify(heap)
    n = made = len(sizes)
    joined: list[tuple[int, int]] = []  # what each node from n on unites
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        sums, other = a + b[::-1], right[::-1]
        node = np.maximum(left, other)
        both = np.flatnonzero((left >= 0) & (other >= 0))
        node[both] = n + len(joined) + np.arange(len(both))
        joined.extend(zip(left[both].tolist(), other[both].tolist()))
        order = np.argsort(-sums, kind="stable")
        sums, node = sums[order], node[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), made, sums, node))
        made += 1
    parts = []
    for top in heap[0][3].tolist():
        part, stack = [], [top] if top >= 0 else []
        while stack:
            k = stack.pop()
            if k < n:
                part.append(k)
            else:
                stack.extend(joined[k - n])
        parts.append(part)
    return parts


def windows_of(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Item numbers of each window: differencing in as few windows as could hold all items, and in one more whenever a window exceeds the capacity."""
    count = max(1, -(-sum(sizes) // capacity))
    parts = differencing(sizes, count)
    while max(sum(sizes[i] for i in p) for p in parts) > capacity:
        count += 1
        parts = differencing(sizes, count)
    return [p for p in parts if p]


#: A run of a document's ids: the document's number, where it begins, how long it is.
Piece = tuple[int, int, int]


class Packer:
    """Sequences of pieces, made as documents come in; holds the remainders of one set of windows at most."""

    def __init__(self) -> None:
        self.rest: list[Piece] = []
        self.size = 0

    def add(self, doc: int, length: int) -> Iterator[list[Piece]]:
        """The sequences that a further document of `length` ids completes.

        Runs of WINDOW ids are sequences of their own.  The remainder is cut into
        pieces of CUT ids at most and joins the waiting set; a set that holds
        WAYS nearly full windows is dealt, its last piece being cut so that it fits.
        """
        whole = length - length % WINDOW
        for start in range(0, whole, WINDOW):
            yield [(doc, start, WINDOW)]
        start, full = whole, WAYS * (WINDOW - SLACK)
        while start < length:
            n = min(CUT, length - start, full - self.size)
            self.rest.append((doc, start, n))
            self.size += n
            start += n
            if self.size == full or len(self.rest) >= MOST_PIECES:
                yield from self._dealt()

    def _dealt(self) -> Iterator[list[Piece]]:
        """Deals the waiting pieces to as many nearly full windows as they fill; what is over waits on."""
        over = self._last(self.size % (WINDOW - SLACK))
        for part in windows_of([p[2] for p in self.rest]):
            yield [self.rest[i] for i in part]
        self.rest, self.size = over, sum(p[2] for p in over)

    def _last(self, n: int) -> list[Piece]:
        """Takes n ids off the end of the waiting pieces."""
        out: list[Piece] = []
        self.size -= n
        while n:
            k, start, length = self.rest.pop()
            take = min(n, length)
            out.append((k, start + length - take, take))
            if take < length:
                self.rest.append((k, start, length - take))
            n -= take
        return out

    def end(self) -> Iterator[list[Piece]]:
        """The remaining sequences: what is over nearly full windows is cut into sequences whose lengths are powers of two, which aren't padded."""
        spare = self.size % (WINDOW - SLACK)
        for bit in range(spare.bit_length() - 1, -1, -1):
            if spare & 1 << bit:
                yield self._last(1 << bit)
        if self.rest:
            yield from self._dealt()


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, a row each.

    A document is its whole text's token ids and the end id 0; a null or empty
    text is that id alone.  A task packs documents as it reads them, so nothing
    is shuffled.  Runs of 1024 tokens of a document are sequences of their own;
    the remainders, in pieces of CUT tokens at most, are dealt to near-equal
    windows by :func:`differencing`, a set of WAYS windows at a time, and the
    count of windows rises where one would exceed 1024 tokens.  What a task's
    last set holds beyond nearly full windows is cut into sequences whose
    lengths are powers of two.  A task holds the remainders of one set.  Returns
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    row_no``; sequence_id is the partition's number times 2^33 plus a running
    number, row_no likewise tells repeated rows apart.
    """
    small_batches(docs.sparkSession)
    columns = ["doc_id", "no_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_no"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _fast(path)
        freed()  # what reading the vocabulary took
        base = TaskContext.get().partitionId() << 33
        packer = Packer()
        held: dict[int, tuple] = {}  # of documents with waiting pieces: id, whether it is null, number of ids, those from `whole` on
        rows: list[tuple] = []
        sequence = 0

        def put(pieces: list[Piece], now: np.ndarray) -> None:
            """Rows of a sequence; `now` are the ids of the document that was added last."""
            nonlocal sequence
            offset = 0
            for k, start, length in pieces:
                i, none, n, rest, first = held[k]
                own = now[start : start + length] if start < first else rest[start - first : start - first + length]
                rows.append((i, none, start, length, zlib.crc32(own.tobytes()), n, base + sequence, offset, base + k))
                offset += length
            sequence += 1

        def taken() -> pd.DataFrame:
            nonlocal rows
            out = pd.DataFrame(rows, columns=columns)
            rows = []
            out["doc_id"] = ids_of(out)
            return out.drop(columns="no_id")

        k = 0
        for b in batches:
            for i, none, t in zip(b["doc_id"].tolist(), b["no_id"].tolist(), b["text"]):
                ids = token_ids(t, path)
                whole = len(ids) - len(ids) % WINDOW
                held[k] = i, none, len(ids), ids[whole:].copy(), whole
                dealt = False
                for pieces in packer.add(k, len(ids)):
                    put(pieces, ids)
                    dealt = dealt or len(pieces) > 1
                if len(ids) == whole:
                    del held[k]
                elif dealt:
                    held = {d: held[d] for d in {p[0] for p in packer.rest}}
                k += 1
                if len(rows) >= ROWS:
                    yield taken()
        for pieces in packer.end():
            put(pieces, np.zeros(0))
        if rows:
            yield taken()

    return keyed(docs, id_col, text_col).mapInPandas(frugal(pack), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_no long")
