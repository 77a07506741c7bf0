"""Byte-level BPE by merge ranks: encoding of overlapping chunks, decoding by concatenation.

A text is cut into chunks that overlap. Every chunk is pre-tokenised from its own first
character, which may lie inside a pre-token. The pattern looks at most one character past a
pre-token and never behind it, so two chunks that share one boundary agree from there on:
the seam is the first boundary of the left chunk, inside the overlap, that the right chunk
has too. Where the overlap holds none (one pre-token longer than the overlap), the left
chunk is extended through the right one. Pieces are then merged by rank and memoised.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, text_last

#: Characters that a match may depend on from its own start, or past its end (contractions, look-ahead).
MARGIN = 8
#: Memoised pieces: longer ones are rare, and the memo is dropped when full.
MEMO_CHARS, MEMO_ITEMS = 64, 400_000
SHORT, NONE = 64, 1 << 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the adjacent pair of lowest rank merges first, leftmost on ties."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:  # the same merges by scanning the few pairs, without a heap
        starts, pairs = list(range(n + 1)), [ranks.get(piece[i:i + 2], NONE) for i in range(n - 1)]
        while pairs and (best := min(pairs)) != NONE:
            i = pairs.index(best)
            del starts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(piece[starts[i]:starts[i + 2]], NONE)
            if i:
                pairs[i - 1] = ranks.get(piece[starts[i - 1]:starts[i + 1]], NONE)
        return [ranks[piece[a:b]] for a, b in itertools.pairwise(starts)]
    parts = [piece[i:i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[pair], i, pair) for i in range(n - 1) if (pair := piece[i:i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i] if parts[i] is not None else n
        if j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(new := pair + parts[k])) is not None:
                heapq.heappush(heap, (r, i, new))
        if (h := left[i]) >= 0 and (r := ranks.get(new := parts[h] + pair)) is not None:
            heapq.heappush(heap, (r, h, new))
    return [ranks[p] for p in parts if p is not None]


class Matcher:
    r"""The pattern with \p{L}, \p{N}, \s and \S spelled out as ranges of code points.

    The ranges come from the regex library; the standard one then matches faster. Texts
    without characters past U+FFFF use a form without those ranges, with the same matches.
    """

    def __init__(self, pattern: str):
        self.plain, self.full = (re.compile(self.explicit(pattern, top)) for top in (0xFFFF, 0x10FFFF))

    @staticmethod
    def explicit(pattern: str, top: int) -> str:
        every = "".join(chr(c) for c in range(top + 1) if not 0xD800 <= c < 0xE000)

        def ranges(name: str) -> str:
            runs = (m.group() for m in regex.finditer(f"(?:{name})+", every))
            return "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in runs)

        out, inside = [], False
        for token in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, regex.S):
            if token in (r"\s", r"\S") or token.startswith(r"\p"):
                found = ranges(token.lower() if token == r"\S" else token)
                token = found if inside else f"[{'^' * (token == r'\S')}{found}]"
            inside = {"[": True, "]": False}.get(token, inside)
            out.append(token)
        return "".join(out)

    def __call__(self, text: str) -> re.Pattern:
        return self.plain if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.full


class PieceMemo(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks), dtype="<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ITEMS:
                self.clear()
            self[piece] = ids
        return ids


def pretokens(text: str, matcher: Matcher, size: int, overlap: int) -> list[str]:
    """Pre-tokens of the whole text from chunks of ``size`` characters plus ``overlap``."""
    n, pattern = len(text), matcher(text)
    if n <= size + overlap:
        return pattern.findall(text)
    chunks = [(s, min(n, s + size + overlap)) for s in range(0, n, size)]
    parts = [pattern.findall(text, s, e) for s, e in chunks]
    done: list[str] = []
    held, start, stop = parts[0], 0, chunks[0][1]  # from a true boundary on, not yet stitched
    for (s, e), nxt in zip(chunks[1:], parts[1:], strict=True):
        own = start + np.cumsum([0, *map(len, held)])  # boundaries of the left chunk
        theirs = s + np.cumsum([0, *map(len, nxt)])
        safe = own[(own >= s) & (own <= stop - MARGIN)]
        common = safe[np.isin(safe, theirs)]
        if len(common):
            seam = common[0]
            done += held[:np.searchsorted(own, seam)]
            held, start = nxt[np.searchsorted(theirs, seam):], int(seam)
        else:  # a pre-token spans the overlap: go on from the last boundary that is sure
            sure = int(own[own <= max(start, stop - MARGIN)][-1])
            done += held[:np.searchsorted(own, sure)]
            held, start = pattern.findall(text, sure, e), sure
        stop = e
    return done + held


@lru_cache(maxsize=2)
def _worker(vocabulary: bytes, pattern: str) -> tuple[PieceMemo, dict[int, bytes], Matcher]:
    ranks = read_ranks(vocabulary)
    return PieceMemo(ranks), {r: b for b, r in ranks.items()}, Matcher(pattern)


def decode_ids(ids: np.ndarray, names: dict[int, bytes]) -> bytes:
    return b"".join(map(names.__getitem__, ids.tolist()))


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, text: str = "text",
           chunk_chars: int = 32_768, overlap_chars: int = 256, keep_ids: bool = True) -> DataFrame:
    """All columns of ``docs`` but the text, with the token ids of every whole text.

    Adds n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of the
    bytes that decoding the ids gives) and, with ``keep_ids``, token_ids. ``vocabulary`` is
    the path of a rank file on the driver; its bytes (under 1 MB) go to the workers. A null
    or empty text has no tokens. Repeated rows stay; other columns pass through, except that
    columns with a result's name give way to it.
    """
    data = open(vocabulary, "rb").read()
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if keep_ids:
        new["token_ids"] = "array<int>"
    rest = [c for c in docs.columns if c != text and c not in new]
    frame = text_last(docs, rest, text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:len(rest)]]
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo, names, matcher = _worker(shared.value, pattern)
        counts, shas, decoded, packed = [], [], [], []
        for value in batch.column(len(rest)).to_pylist():
            raw = b"".join(map(memo.__getitem__, pretokens(value, matcher, chunk_chars, overlap_chars)))
            ids = np.frombuffer(raw, dtype="<u4")
            counts.append(len(ids))
            shas.append(hashlib.sha256(raw).hexdigest())
            decoded.append(hashlib.sha256(decode_ids(ids, names)).hexdigest())
            packed.append(ids)
        columns = [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
        if keep_ids:
            ends = list(itertools.accumulate(counts, initial=0))
            flat = np.concatenate([*packed, np.zeros(0, "<u4")]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
        return pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], *columns], names=[*rest, *new])

    return arrow_map(frame, work, ", ".join([*fields, *(f"{k} {v}" for k, v in new.items())]))


def decode(tokens: DataFrame, vocabulary: str, *, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids' tokens, in order (binary). A null list decodes to null."""
    data = open(vocabulary, "rb").read()
    rest = [c for c in tokens.columns if c != out]
    frame = tokens.select(*rest)
    at = rest.index(ids)
    shared = tokens.sparkSession.sparkContext.broadcast(data)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = _worker(shared.value, ".")[1]
        got = [None if x is None else b"".join(map(names.__getitem__, x)) for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*rest, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema]
    return arrow_map(frame, work, ", ".join([*fields, f"{out} binary"]))
