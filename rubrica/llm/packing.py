"""Sum-of-squares packing of token streams into windows, online and per partition.

Every partition packs its own documents, so nothing is shuffled and a lost task is simply run again. A document's ids (with
an end id) first give whole windows of `window` ids; the rest, shorter than a window, is an item. A partition holds a level
array: for each fill level the partly filled windows at that level. An item goes to the level (or a new window) at which
the sum over levels of the squared number of partly filled windows becomes least; full windows leave the array. Levels that
need no padding (powers of two) count nothing.

Windows still open at the end of a partition, or beyond `max_open` of them, are joined: documents may be cut freely, so
their pieces are laid end to end into full windows, and what remains last is laid into windows whose lengths are powers of
two, which need no padding. Memory is bounded by `max_open` windows and one Arrow batch of texts.

Tokens: a text is cut before white space that follows other characters and after runs of letters that punctuation ends,
where no token of the vocabulary's splitting pattern can reach across; the ids of each such unit are found once with the
tokenizer and kept in a bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rubrica.llm.common import pick

#: Unicode's White_Space, as the splitting pattern understands \s; a fixed value.
_SPACE = "\t-\r \x85\xa0" + "".join(
    map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
#: Letters of which a run that ASCII punctuation or white space ends is surely one token of the splitting pattern.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
UNITS = re.compile(f"[{_SPACE}]*[{_LETTER}]+(?=[{_SPACE}!-/:-@[-`{{-~]|\\Z)|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
WORD_UNIT = re.compile(f" ?[{_LETTER}]+")
UNITS_KEPT = 200_000  # at most twice as many, about 80 MB, are held by a worker
PIECES = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
)


class _Units(dict):
    """Ids of text units as little-endian unsigned 32-bit bytes. When it holds UNITS_KEPT, all but those used since it was
    last full are forgotten.

    A unit that is a single word goes to the vocabulary's merges directly, in the byte alphabet of a byte-level vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merged = self.tokenizer.model.tokenize
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.older: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= UNITS_KEPT:
            self.older = dict(self)
            self.clear()
        found = self.older.get(unit)
        if found is None:
            if WORD_UNIT.fullmatch(unit):
                ids = [t.id for t in self.merged(unit.encode().decode("latin-1").translate(self.alphabet))]
            else:
                ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
            found = np.array(ids, dtype="<u4").tobytes()
        self[unit] = found
        return found


_UNITS: dict[str, _Units] = {}  # a worker's tasks share the tokenizer and what it has found, within the bound above


def encoder(path: str):
    """Text to the bytes of its ids, as the tokenizer file at `path` gives them for the whole text."""
    units = _UNITS[path] = _UNITS.get(path) or _Units(path)
    return lambda text: b"".join(map(units.__getitem__, UNITS.findall(text)))


class Packer:
    """One partition's level array. `put` and `finish` return pieces (doc, start, length, doc_tokens, window, offset, ids)."""

    def __init__(self, window: int = 2048, max_open: int = 4096):
        self.window, self.max_open, self.next, self.n_open = window, max_open, 0, 0
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.levels: dict[int, list] = {}
        levels = np.arange(window + 1)
        #: levels at which a window needs no padding, and so costs nothing
        self.free = (levels & (levels - 1)) == 0
        self.free[window] = True

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, doc, ids: bytes) -> list[tuple]:
        total, size, out = len(ids) // 4, self.window, []
        whole = total - total % size
        for start in range(0, whole, size):
            out.append((doc, start, size, total, self._new(), 0, ids[4 * start : 4 * (start + size)]))
        n = total - whole
        if n:
            out += self._place(n, (doc, whole, n, total, ids[4 * whole :]))
        return out

    def _place(self, n: int, piece: tuple) -> list[tuple]:
        """Into the level h for which the sum of squares grows least: N(h+n) rises by one and N(h) falls by one."""
        h = np.arange(self.window - n + 1)
        cost = np.where(self.free[h + n], 0, 2 * self.counts[h + n] + 1) - np.where(self.free[h], 0, 2 * self.counts[h] - 1)
        usable = self.counts[h] > 0
        usable[0] = True  # a new window
        # of equal costs the fullest level
        best = int(h[-1] - np.argmin(np.where(usable, cost, np.iinfo(np.int64).max)[::-1]))
        if best == 0:
            window = (self._new(), [])
            self.n_open += 1
        else:
            window = self.levels[best].pop()
            self.counts[best] -= 1
        window[1].append((piece, best))
        if best + n == self.window:
            self.n_open -= 1
            return [(*p[:4], window[0], at, p[4]) for p, at in window[1]]
        self.levels.setdefault(best + n, []).append(window)
        self.counts[best + n] += 1
        return self.finish() if self.n_open > self.max_open else []

    def finish(self) -> list[tuple]:
        """Lay all open pieces end to end; the last, shorter windows have powers of two as lengths."""
        pieces, out = [], []
        for level in sorted(self.levels):
            for number, held in self.levels[level]:
                if self.free[level]:
                    out += [(*p[:4], number, at, p[4]) for p, at in held]
                else:
                    pieces += [p for p, _ in held]
        left = sum(p[2] for p in pieces)
        room, number, at = 0, -1, 0
        for doc, start, n, total, ids in pieces:
            used = 0
            while used < n:
                if room == 0:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    number, at = self._new(), 0
                take = min(room, n - used)
                out.append((doc, start + used, take, total, number, at, ids[4 * used : 4 * (used + take)]))
                used, room, at, left = used + take, room - take, at + take, left - take
        self.levels, self.n_open = {}, 0
        self.counts[:] = 0
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, max_open: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Every id of every document lies in exactly one piece. A null or empty text is the end id alone; repeated rows are
    packed each. An empty table gives no pieces. `window` is a power of two. A sequence id is the partition's number and a
    count within it. Other columns of `docs` are not read.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())]
    )

    def rows(pieces: list[tuple], base: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(pieces), 4000):
            cols = list(zip(*pieces[i : i + 4000], strict=True))
            doc, start, length, total, number, at, ids = cols
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip((doc, start, length, total, [base + n for n in number], at, ids), schema.types, strict=True)],
                schema=schema,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(window, max_open)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += packer.put(doc, encode(text or "") + end)
            yield from rows(out, base)
        yield from rows(packer.finish(), base)

    d = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return d.mapInArrow(run, PIECES)


def pack_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    pieces = pack(docs, tokenizer)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
