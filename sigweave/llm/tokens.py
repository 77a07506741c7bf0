"""Token counts from a finite-state transducer that is compiled from a BPE piece table.

Every prefix of a text has one last token: the suffix piece that, next to the last token
before it, stays apart when the two are merged on their own. The last tokens of the
positions at which a piece may still begin, and the token counts since them, are all that
later text can depend on. They form the state; they are finitely many, because pieces are.
A transition carries the change in the number of tokens, so the count of a text is the sum
along its path. States are compiled when a text first reaches them.

Words (a run of spaces and what follows it up to the next space) never share a piece, so a
space after another character, and any character outside the pieces, leads back to the
start state. Texts are cut into chunks. A chunk's state map sends an entry state to the
exit state and the tokens in between. Each chunk is first mapped from the state that a short
look-back suggests; a prefix scan composes the maps, and a chunk whose entry state turns out
to be another one is mapped again from that state. Chunks advance side by side, one numpy
step for each character position.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map, text_last

SPACE_MARK = "▁"
#: Characters with a column of their own in the transition table: the most frequent in the pieces.
#: Transitions on others are looked up one by one.
DENSE = 121


def read_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece BPE model with their scores.

    Refuses models whose pieces hold a space mark after another character, or characters
    without a piece of their own: the transducer relies on both.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.vocab_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = model.get_score(i)
    if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
        raise ValueError("a piece crosses a word boundary")
    if {c for p in pieces for c in p} - pieces.keys():
        raise ValueError("a character of a piece has no piece of its own")
    return pieces


class Transducer:
    """Deterministic transducer from characters to changes of the token count.

    State 0 is the start of a word. Cell (s, c) of ``cells`` packs the next state (from bit
    6 on) and the change of the count plus 32; -1 stands for a transition not yet compiled.
    Classes: 0 a space that continues a run, 1 one that opens a word, 2-5 a character
    outside the pieces of 1-4 bytes, 6 a rare character, then the frequent ones.
    """

    OPENS, OUTSIDE, RARE, FREQUENT = 1, 2, 6, 7

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.opens = {p[:k] for p in pieces for k in range(1, len(p))}  # what a longer piece may extend
        common: dict[str, int] = {}
        for p in pieces:
            for c in p:
                common[c] = common.get(c, 0) + 1
        self.frequent = sorted(common.keys() - {SPACE_MARK}, key=lambda c: (-common[c], c))[:DENSE]
        self.width = self.FREQUENT + len(self.frequent)
        self.apart: dict[tuple[str | None, str], bool] = {}
        self.links: dict[tuple[str, str], tuple] = {}
        self.rare: dict[tuple[int, str], int] = {}
        self.keys: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.cells = np.full(1024 * self.width, -1, np.int32)
        self.state("", ((None, 0),))
        self.class_of = np.zeros(max(0x10000, *map(ord, common)) + 1, np.int16)
        code = np.arange(len(self.class_of))
        self.class_of[:] = self.OUTSIDE + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        for c in common:
            self.class_of[ord(c)] = self.RARE
        for i, c in enumerate(self.frequent):
            self.class_of[ord(c)] = self.FREQUENT + i
        self.class_of[[ord(" "), ord(SPACE_MARK)]] = 0

    def compatible(self, before: str | None, token: str) -> bool:
        """Do the two tokens stay as they are when merged on their own?

        The adjacent pair of best score merges first, leftmost on ties.
        """
        key = (before, token)
        if (known := self.apart.get(key)) is None:
            parts, find = list((before or "") + token), self.pieces.get
            while len(parts) > 1:
                best, at = None, 0
                for i in range(len(parts) - 1):
                    if (score := find(parts[i] + parts[i + 1])) is not None and (best is None or score > best):
                        best, at = score, i
                if best is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            known = self.apart[key] = parts == ([before, token] if before else [token])
        return known

    def state(self, suffix: str, trail: tuple) -> int:
        key = (suffix, trail)
        if (n := self.keys.get(key)) is None:
            self.keys[key] = n = len(self.states)
            self.states.append(key)
            if (n + 1) * self.width > len(self.cells):
                self.cells = np.concatenate([self.cells, np.full(self.width * (n // 2), -1, np.int32)])
        return n

    def link(self, suffix: str, c: str) -> tuple:
        """What holds for every state with this suffix that reads ``c``.

        Pieces that may end here, longest first, with the trail entry at their start; the
        new suffix; the trail entries that stay.
        """
        starts = [0, *(k for k in range(1, len(suffix) + 1) if suffix[-k:] in self.opens)]
        slot = {k: i for i, k in enumerate(starts)}
        grown = suffix + c
        ends = [grown[-k:] for k in range(1, len(grown) + 1)]
        tokens = tuple((slot[len(e) - 1], e) for e in reversed(ends) if e in self.pieces)
        opening = [e for e in ends if e in self.opens]
        return tokens, opening[-1] if opening else "", tuple(slot[len(e) - 1] for e in opening)

    def compile(self, s: int, c: str) -> int:
        """Packed transition of state ``s`` on an ordinary character of the pieces.

        A state's suffix is the longest end of the word so far that a longer piece may
        extend. Its trail has, for the current position and for each place inside the suffix
        where such a piece begins, the last token before it and the tokens emitted since.
        """
        suffix, trail = self.states[s]
        if (known := self.links.get((suffix, c))) is None:
            known = self.links[suffix, c] = self.link(suffix, c)
        tokens, longest, stay = known
        for slot, token in tokens:
            before, since = trail[slot]
            if self.compatible(before, token):
                break
        change = 1 - since
        to = self.state(longest, ((token, 0), *[(trail[i][0], trail[i][1] + change) for i in stay]))
        return to << 6 | change + 32

    def fill(self, s: int, c: int) -> None:
        """Compile one missing cell."""
        if c == self.OPENS:
            packed = self.compile(0, SPACE_MARK)
        elif self.OUTSIDE <= c < self.RARE:
            packed = c - self.OUTSIDE + 1 + 32
        else:
            packed = self.compile(s, SPACE_MARK if c == 0 else self.frequent[c - self.FREQUENT])
        self.cells[s * self.width + c] = packed

    def advance(self, s: np.ndarray, c: np.ndarray, points: np.ndarray, where: np.ndarray) -> np.ndarray:
        """One packed transition for every lane, at the characters ``where``."""
        cell = s * self.width + c
        packed = self.cells.take(cell)
        if packed.min() < 0:
            missing = np.flatnonzero(packed < 0)
            rare = c[missing] == self.RARE
            for key in np.unique(cell[missing[~rare]]).tolist():
                self.fill(*divmod(key, self.width))
            packed = self.cells.take(cell)
            for i in missing[rare].tolist():
                key = (int(s[i]), chr(points[where[i]]))
                if (known := self.rare.get(key)) is None:
                    known = self.rare[key] = self.compile(*key)
                packed[i] = known
        return packed


def _run(t: Transducer, codes: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray,
         entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exit states and tokens of all lanes [start, end) from their entry states."""
    order = np.argsort(starts - ends, kind="stable")  # longest lanes first, so that live lanes are a prefix
    s, at = entry[order], starts[order]
    lens = (ends - starts)[order]
    total = np.zeros(len(order), np.int64)
    steps = int(lens[0]) if len(order) else 0
    live = len(order) - np.searchsorted(lens[::-1], np.arange(steps), side="right")
    for i, n in enumerate(live.tolist()):
        where = at[:n] + i
        packed = t.advance(s[:n], codes.take(where), points, where)
        np.right_shift(packed, 6, out=s[:n], casting="unsafe")
        total[:n] += packed & 63
    out_s, out_n = np.empty_like(s), np.empty_like(total)
    out_s[order], out_n[order] = s, total - 32 * lens
    return out_s, out_n


def count_tokens(t: Transducer, texts: list[str], chunk: int, look_back: int) -> np.ndarray:
    """Tokens of each text: chunk state maps, composed by a scan over the chunks of all texts."""
    lengths = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
    if not lengths.sum():
        return np.zeros(len(texts), np.int64)
    joined = "".join(" " + x for x in texts if x)  # a space precedes every text
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = t.class_of[np.minimum(points, len(t.class_of) - 1)]
    codes[points >= len(t.class_of)] = t.OUTSIDE + 3
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    mark = codes == 0
    codes[mark & ~np.concatenate([[False], mark[:-1]])] = t.OPENS
    codes[offsets[:-1][lengths > 0]] = t.OPENS
    per_text = -(-lengths // chunk)
    first = np.concatenate([[0], np.cumsum(per_text)])
    owner = np.repeat(np.arange(len(texts)), per_text)
    number = np.arange(len(owner)) - first[owner]
    starts = offsets[owner] + number * chunk
    ends = np.minimum(starts + chunk, offsets[owner + 1])
    entry, _ = _run(t, codes, points, np.maximum(starts - look_back * (number > 0), offsets[owner]), starts,
                    np.zeros(len(owner), np.int64))
    exits, tokens = _run(t, codes, points, starts, ends, entry)
    while True:  # a map applies if its entry state is the exit state of the chunk before
        due = np.where(number > 0, np.concatenate([[0], exits[:-1]]), 0)
        # a chunk that opens a word, or with a character outside the pieces, maps all states alike
        wrong = np.flatnonzero((due != entry) & ((codes[starts] == 0) | (codes[starts] >= t.RARE)))
        if not len(wrong):
            break
        entry[wrong] = due[wrong]
        exits[wrong], tokens[wrong] = _run(t, codes, points, starts[wrong], ends[wrong], entry[wrong])
    return np.bincount(owner, weights=tokens, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=1)
def _worker(pieces: tuple) -> Transducer:
    return Transducer(dict(pieces))


#: States after which a worker starts its transducer anew, so that its memory stays bounded.
MAX_STATES = 330_000


def token_counts(docs: DataFrame, model: str, *, text: str = "text", limit: int = 4096,
                 chunk_chars: int = 512, look_back: int = 32) -> DataFrame:
    """All columns of ``docs`` but the text, with n_bytes (UTF-8), n_tokens and over_limit.

    Counts are those of the sentencepiece model at ``model`` (a path on the driver) without
    begin and end tokens. A null or empty text has no bytes and no tokens. Repeated rows
    stay; columns named like a result give way to it.
    """
    pieces = tuple(read_pieces(model).items())
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    new = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}
    rest = [c for c in docs.columns if c != text and c not in new]
    frame = text_last(docs, rest, text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = _worker(shared.value)
        if len(t.states) > MAX_STATES:
            _worker.cache_clear()
            t = _worker(shared.value)
        column = batch.column(len(rest))
        counts = count_tokens(t, column.to_pylist(), chunk_chars, look_back)
        sizes = np.array(pc.binary_length(column), np.int64)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:len(rest)], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)],
            names=[*rest, *new])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:len(rest)]]
    return arrow_map(frame, work, ", ".join([*fields, *(f"{k} {v}" for k, v in new.items())]))
