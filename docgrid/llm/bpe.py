"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import ids_of, keyed, small_batches

#: How a byte-level tokenizer cuts text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of which a worker remembers the encoding, in each of two generations.
KNOWN_PIECES = 250_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer file (JSON), with encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in self.vocab.items() if all(c in back for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.new: dict = {}
        self.old: dict = {}

    def merged(self, piece: str) -> list[int]:
        """Token ids of one piece.

        Symbols form a doubly linked list; adjacent pairs wait in a heap by rank
        and place, one whole number each.  A popped entry counts only if the pair
        at its place still has its rank; otherwise it is stale and skipped.
        """
        letters = self.letters
        symbol: list = [letters[b] for b in piece.encode()]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        rank = [get(pair, -1) for pair in zip(symbol, symbol[1:])]
        rank.append(-1)
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            if rank[i] != entry >> 32:
                continue
            j = after[i]
            s = symbol[i] = symbol[i] + symbol[j]
            symbol[j], rank[j], rank[i] = None, -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank[i] = r = get((s, symbol[k]), -1)
                if r >= 0:
                    push(heap, r << 32 | i)
            if (h := before[i]) >= 0:
                rank[h] = r = get((symbol[h], s), -1)
                if r >= 0:
                    push(heap, r << 32 | h)
        vocab = self.vocab
        return [vocab[s] for s in symbol if s is not None]

    def _piece(self, piece: str) -> tuple[int, str, bytes]:
        """(number of ids, ids joined by commas, their vocabulary strings joined); remembered for pieces of usual length."""
        found = self.old.get(piece)
        if found is None:
            ids = self.merged(piece)
            found = (len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids)))
            if len(piece) > 64:
                return found
        if len(self.new) >= KNOWN_PIECES:
            self.old, self.new = self.new, {}
        self.new[piece] = found
        return found

    def _pieces(self, text: str) -> Iterator[tuple[int, str, bytes]]:
        at = 0
        for m in self.specials.finditer(text) if self.specials and self.specials.search(text) else ():
            yield from self._plain(text[at : m.start()])
            i = self.added[m.group()]
            yield 1, str(i), self.bytes_of[i]
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[tuple[int, str, bytes]]:
        get, make = self.new.get, self._piece
        out = []
        for p in self.split.findall(text):
            found = get(p)
            if found is None:
                found = make(p)
                get = self.new.get
            out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; added tokens in it are single ids."""
        return [int(i) for _, ids, _ in self._pieces(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids joined; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
        pieces = list(self._pieces(text))
        ids = ",".join([p[1] for p in pieces])
        back = b"".join([p[2] for p in pieces]).decode("utf-8", "replace")
        return sum([p[0] for p in pieces]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """The vocabulary at a path, read once in each worker."""
    return Bpe(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded``: token ids of each whole text and the text decoded from them; null texts count as empty, which have no ids."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = bpe(path)
        for b in batches:
            ids = [tool.encode(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": ids_of(b), "ids": ids, "decoded": [tool.decode(i) for i in ids]})

    return keyed(docs, id_col, text_col).mapInPandas(encode, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row's whole text: :func:`encoded` without carrying ids and texts.

    Null texts count as empty; an empty text has no ids, and both digests are
    those of an empty string.  Repeated rows and null ids give a row each.
    """
    small_batches(docs.sparkSession)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = bpe(path)
        for b in batches:
            out = pd.DataFrame([tool.digest(t) for t in b["text"]], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", ids_of(b))
            yield out

    return keyed(docs, id_col, text_col).mapInPandas(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
