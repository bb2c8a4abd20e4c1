"""Byte-level BPE by monoid tree reduction.

A text is halved until its leaves are short; leaves are encoded as they stand, by the definition, and neighbours are joined up the tree. What a join keeps is proven stable:

* Pieces (matches of the pattern). A piece of the left half is kept if it ends three characters or more before the half
  does, for the pattern never looks further ahead. From there the pattern is run again, over a window that grows piece by
  piece, until it stands on a piece boundary of the right half: from such a place on a scan depends on what follows only.
* Tokens inside one piece. The bytes around the seam are encoded again, over a window that grows on both sides, until the
  window's outer tokens fit the tokens outside it: a sequence is the BPE encoding of its bytes if and only if each pair of
  neighbours is the encoding of the pair's own bytes. A window that reaches both ends is the piece itself, merged pair by
  pair from a heap, in n log n steps: so a run of one character, whose tokens shift with its length, costs no more.

Decoding concatenates the tokens' bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import types
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import raw_texts

LEAF_CHARS, LEAF_BYTES, LEAF_TOKENS, LOOK, SHORT = 2048, 24, 1 << 16, 3, 64
CACHED = 300_000
_NONE = 1 << 62
#: Latin letters, ASCII digits and marks: texts of these alone are split by a plainer pattern that says the same of them.
_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
_SPACE = " \t\n\r\f\v"
_PLAIN = re.compile(f"[^\\x20-\\x7e\t\n\r\f\v{_LETTER}]")
_GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FAST = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Bpe:
    """Encoder and decoder for a vocabulary of ranks (bytes to id) and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks, self.full, self.leaf_chars, self.leaf_bytes = ranks, regex.compile(pattern), max(leaf_chars, 1), max(leaf_bytes, 1)
        self.fast = _FAST if pattern == _GPT2 else None
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.byte_id = [ranks[bytes([c])] for c in range(256)]
        self.merged = {ranks[t[:k]] << 32 | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.packed = {i: struct.pack("<I", i) for i in self.bytes_of}
        self.codes: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    # Pieces of a text

    def pieces(self, text: str) -> list[str]:
        rx = self.fast if self.fast and not _PLAIN.search(text) else self.full
        return self._pieces(text, 0, len(text), rx)

    def _pieces(self, text: str, a: int, b: int, rx) -> list[str]:
        if b - a <= self.leaf_chars:
            return rx.findall(text, a, b)
        m = (a + b) // 2
        left, right = self._pieces(text, a, m, rx), self._pieces(text, m, b, rx)
        at = m
        while left and at > m - LOOK:
            at -= len(left.pop())
        edge, skip = m, 0
        for x in rx.finditer(text, at, b):
            while edge < x.start():
                edge += len(right[skip])
                skip += 1
            if edge == x.start() and edge >= m:
                break
            left.append(x.group())
        else:
            skip = len(right)
        left += right[skip:]
        return left

    # Tokens of a piece

    def _merge(self, piece: bytes) -> list[int]:
        """By the definition: the pair of least rank is merged, the leftmost first, until none is left."""
        if len(piece) > SHORT:
            return self._merge_long(piece)
        parts, merged = [self.byte_id[c] for c in piece], self.merged.get
        near = [merged(x << 32 | y, _NONE) for x, y in zip(parts, parts[1:])]
        while near:
            least = min(near)
            if least == _NONE:
                break
            k = near.index(least)
            parts[k] = least
            del parts[k + 1], near[k]
            if k < len(near):
                near[k] = merged(least << 32 | parts[k + 1], _NONE)
            if k:
                near[k - 1] = merged(parts[k - 1] << 32 | least, _NONE)
        return parts

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same in n log n steps: pairs wait in a heap, parts are linked."""
        n, merged = len(piece), self.merged.get
        parts, after, before = [self.byte_id[c] for c in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := merged(parts[k] << 32 | parts[k + 1])) is not None]
        heapify(heap)
        while heap:
            least, k = heappop(heap)
            j = after[k]
            if parts[k] < 0 or j >= n or merged(parts[k] << 32 | parts[j]) != least:
                continue  # one of the pair has gone into another since
            parts[k], parts[j], after[k] = least, -1, after[j]
            if after[j] < n:
                before[after[j]] = k
                if (r := merged(least << 32 | parts[after[j]])) is not None:
                    heappush(heap, (r, k))
            if before[k] >= 0 and (r := merged(parts[before[k]] << 32 | least)) is not None:
                heappush(heap, (r, before[k]))
        return [p for p in parts if p >= 0]

    def _fit(self, x: int, y: int) -> bool:
        """Whether two neighbours are the encoding of their bytes."""
        if (known := self.fits.get(x << 32 | y)) is None:
            known = self._merge(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
            if len(self.fits) < CACHED:
                self.fits[x << 32 | y] = known
        return known

    def tokens(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self._merge(piece)
        m = len(piece) // 2
        return self.join(self.tokens(piece[:m]), self.tokens(piece[m:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings of one piece's halves."""
        i = j = 2
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._merge(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j])))
            before = i == len(left) or self._fit(left[-i - 1], window[0])
            after = j == len(right) or self._fit(window[-1], right[j])
            if before and after:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if before else 2 * i, j if after else 2 * j

    # Whole texts

    def _code(self, piece: str) -> bytes:
        raw = piece.encode()
        if (whole := self.ranks.get(raw)) is not None:
            ids = [whole]
        else:
            ids = self.tokens(raw)
        code = b"".join([self.packed[i] for i in ids])
        if len(self.codes) < CACHED and len(piece) <= 64:
            self.codes[piece] = code
        return code

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, code = self.codes.get, self._code
        return b"".join([get(p) or code(p) for p in self.pieces(text)])

    def decode(self, ids: bytes) -> bytes:
        return self._decode(np.frombuffer(ids, "<u4"))

    def _decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        m = len(ids) // 2
        return self._decode(ids[:m]) + self._decode(ids[m:])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}


def _shared(path: str, pattern: str) -> Bpe:
    """One encoder a worker process, kept from task to task with what it has encoded."""
    kept = sys.modules.setdefault("_lamina_bpe", types.ModuleType("_lamina_bpe")).__dict__
    if (path, pattern) not in kept:
        kept[path, pattern] = Bpe(load_ranks(path), pattern)
    return kept[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, tokens: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids (array of int) if asked for.

    path names the vocabulary's ranks on every worker. Null texts are empty: no tokens, and the digests of no bytes.
    Null doc_ids and repeated rows return as they are; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(path, pattern)
        for batch in batches:
            n, ids, back, kept = [], [], [], []
            for t in batch.column(1):
                code = bpe.encode(t.as_py().decode())
                n.append(len(code) // 4)
                ids.append(hashlib.sha256(code).hexdigest())
                back.append(hashlib.sha256(bpe.decode(code)).hexdigest())
                if tokens:
                    kept.append(np.frombuffer(code, "<u4").astype(np.int32))
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if tokens:
                out.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return raw_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * tokens)
