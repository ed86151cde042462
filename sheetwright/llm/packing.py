"""Packing of tokenised documents into sequences: Martello-Toth dominance reduction, then best fit.

Token counts are at most ``capacity``, so the whole instance is a histogram of at most ``capacity`` numbers, whatever
the corpus's size.  The plan is made on the histogram:

* Dominance.  A set of pieces dominates a piece's alternatives if every other set that holds the piece could be
  exchanged for it without another sequence.  That holds for a piece that leaves no room for the smallest other one; for
  a piece and the partner that exactly fills the rest; and, where at most one more piece has room, for a piece and the
  largest that fits.  Such sets are fixed for good, for all copies at once, and the instance shrinks; this is repeated
  until nothing changes.
* Best fit, largest first, packs the remainder: a piece goes to the fullest open sequence that has room for it.

The plan says, for each length, which run of pieces (numbered within their length) goes to which run of sequences and at
what offset.  Pieces are numbered where they are made, by task; sums of the tasks' counts over the earlier tasks turn
that into a number within the length.  No group of pieces is ever gathered.

A document is its token ids and a closing id.  Only documents longer than ``capacity`` are cut; the first piece takes
what is left over after full pieces.

Defined results: a null text is empty, so only its closing id is packed; repeated rows are packed each time; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sliced

CAPACITY = 2048
CLOSING_ID = 0
#: White space of so many characters on end is left to the library.
LONG_SPACE = 4096
SPACES = re.compile(rf"\s{{{LONG_SPACE}}}")


class Encoder:
    """Token ids of whole texts by a byte-level BPE vocabulary, equal to the ``tokenizers`` library's.

    The same vocabulary is read as merge ranks, which encode about four times as fast.  Texts that hold the string of a
    special token, which the ranks don't know, or white space of LONG_SPACE characters on end, which exhausts the stack of
    their pattern matcher, go to the library itself.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or len(text) >= LONG_SPACE and SPACES.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.ranks.encode_ordinary(text), dtype="<u4")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, ranks: str, pattern: str) -> Encoder:
    """This process's encoder for a vocabulary."""
    key = (vocabulary, ranks)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, ranks, pattern)
    return _ENCODERS[key]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first one that takes what is left over."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised_pieces(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: (id_col, piece, start, length, ids_crc32, task, nth), nth numbering a task's pieces of one length.

    The caller must write the table before using it, since task numbers belong to one run.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", "task", "nth"]

    def work(batches):
        own, task = encoder(vocabulary, ranks, pattern), TaskContext.get().partitionId()
        made: dict[int, int] = defaultdict(int)
        for batch in sliced(batches):
            rows: list[tuple] = []
            for i, text in enumerate(batch.column("__text__").to_pylist()):
                data = np.append(own.encode(text or ""), np.array([CLOSING_ID], dtype="<u4"))
                for piece, (start, length) in enumerate(cut_points(len(data), capacity)):
                    rows.append((i, piece, start, length, zlib.crc32(data[start : start + length]), task, made[length]))
                    made[length] += 1
            if rows:
                at, *columns = zip(*rows, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("__id__").take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long"
    return docs.select(F.col(id_col).alias("__id__"), F.col(text_col).alias("__text__")).mapInArrow(work, schema)


class Plan:
    """Where the pieces of each length go: runs (length, first number, each, sequence, offset, count).

    Of a run, piece ``first + i`` lies in sequence ``sequence + i // each`` at ``offset + (i % each) * length``.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.runs, self.sequences, self.fixed = capacity, [], 0, 0
        self.left = {n: c for n, c in histogram.items() if c}
        self.sizes = sorted(self.left)
        self.used: dict[int, int] = defaultdict(int)
        self._reduce()
        self._best_fit()

    def _take(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], each, sequence, offset, count))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            del self.sizes[bisect_left(self.sizes, length)]

    def _open(self, sets: int) -> int:
        self.sequences += sets
        return self.sequences - sets

    def _fix(self, length: int, partner: int | None, sets: int) -> None:
        at = self._open(sets)
        self.fixed += sets
        if partner == length:
            self._take(length, 2 * sets, 2, at, 0)
            return
        self._take(length, sets, 1, at, 0)
        if partner:
            self._take(partner, sets, 1, at, length)

    def _reduce(self) -> None:
        """Fix dominating sets until none is left."""
        changed = True
        while changed:
            changed = False
            for length in self.sizes[::-1]:
                while length in self.left and (found := self._dominating(length)):
                    self._fix(length, *found)
                    changed = True

    def _dominating(self, length: int) -> tuple[int | None, int] | None:
        """A partner (or none) and how many such sets can be fixed."""
        room, own = self.capacity - length, self.left[length]
        others = lambda size: self.left.get(size, 0) - (size == length)
        sets = lambda size: own // 2 if size == length else min(own, self.left[size])
        smallest = next((s for s in self.sizes[:2] if others(s) > 0), None)
        if smallest is None or smallest > room:
            return None, 1 if smallest == length or length in self.sizes[:1] and own > 1 else own
        if others(room) > 0:
            return room, sets(room)
        if 2 * smallest > room:
            k = bisect_left(self.sizes, room + 1) - 1
            while others(self.sizes[k]) <= 0:
                k -= 1
            return self.sizes[k], sets(self.sizes[k])
        return None

    def _best_fit(self) -> None:
        """Largest first, each to the fullest sequence with room; sequences that are alike are handled as one run."""
        opened: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by room: (first sequence, how many, used)
        rooms: list[int] = []

        def put(sequence: int, many: int, used: int) -> None:
            room = self.capacity - used
            if many and room:
                if not opened[room]:
                    insort(rooms, room)
                opened[room].append((sequence, many, used))

        while self.sizes:
            length = self.sizes[-1]
            while length in self.left:
                k = bisect_left(rooms, length)
                if k < len(rooms):
                    room = rooms[k]
                    sequence, many, used = opened[room].pop()
                    if not opened[room]:
                        rooms.pop(k)
                else:
                    room, used = self.capacity, 0
                    many = -(-self.left[length] // (self.capacity // length))
                    sequence = self._open(many)
                each, have = room // length, self.left[length]
                full = min(many, have // each)
                if full:
                    self._take(length, full * each, each, sequence, used)
                    put(sequence, full, used + each * length)
                if full < many:
                    rest = min(have - full * each, each)
                    if rest:
                        self._take(length, rest, rest, sequence + full, used)
                        put(sequence + full, 1, used + rest * length)
                        full += 1
                    put(sequence + full, many - full, used)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs sorted by (length, first number), and the key to search them by."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 6)
        return runs, (runs[:, 0] << 48) | runs[:, 1]


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a written table) with sequence_id and offset."""
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(_window("length", "task")) - F.col("n")
    before = counts.select("task", "length", earlier.alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    shared = pieces.sparkSession.sparkContext.broadcast(Plan(histogram, capacity).arrays())
    kind = pieces.schema[id_col].dataType.simpleString()
    keep = [id_col, "piece", "start", "length", "ids_crc32"]

    def work(batches):
        runs, keys = shared.value
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            run = runs[np.searchsorted(keys, (length << 48) | number, side="right") - 1]
            i = number - run[:, 1]
            sequence, offset = run[:, 3] + i // run[:, 2], run[:, 4] + (i % run[:, 2]) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.join(before, ["task", "length"]).select(*keep, "nth", "before").mapInArrow(work, schema)


def _window(part: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def pack_documents(docs: DataFrame, scratch: Scratch, vocabulary: str, ranks: str, pattern: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise ``docs`` and pack them: one row a piece."""
    pieces = scratch.table(tokenised_pieces(docs, vocabulary, ranks, pattern, capacity, id_col, text_col), "pieces")
    return pack(pieces, id_col, capacity)
