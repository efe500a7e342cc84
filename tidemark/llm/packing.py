"""Best-fit-decreasing packing of token sequences.

The lengths to pack are whole numbers from 1 to the sequence length, so the state of best-fit decreasing is a
count of open bins for each remaining capacity. The driver runs the algorithm on the histogram of lengths: it
takes lengths from the longest to the shortest and asks a segment tree over the remaining capacities for the
tightest one that still fits; all bins of that capacity, and all the documents of that length, are then placed in
one step. That gives the same bins as placing documents one by one, while the work and the size of the plan
depend on the sequence length only, not on the number of documents. Documents get their places from their rank
within their length, found by a range partitioning that splits lengths which many documents share.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

#: Entries after which a worker's dictionary starts anew. It changes speed and memory only.
DICTIONARY_SIZE = 600_000
#: Characters that Python and the tokenizers' patterns may not both take for white space.
_ODD = re.compile("[\x1c-\x1f\x85᠎​-‍⁠﻿]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class SegmentTree:
    """Which remaining capacities have open bins; finds the least one of at least a given size in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, at: int, value: bool) -> None:
        at += self.size
        while at and self.any[at] != value:
            self.any[at] = value
            at //= 2
            if at:
                value = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:  # climb to the first right sibling that holds an open bin, then go down to its left-most leaf
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Steps (length, first rank, documents, documents a bin, first bin, offset), and the number of bins.

    Step: the documents of that length and of ranks first..first+documents-1 go to bins from ``first bin`` on,
    so many in each, from ``offset`` on. Best fit among equally tight bins takes any; here, the earliest range.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> ranges (first bin, bins)
    tree, steps, bins = SegmentTree(capacity), [], 0

    def leave(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_bins.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # every further document of this length opens a bin, or follows the one that did
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length  # once a bin has taken one of them it is the tightest, until it is too full
            full = min(n, left // each)
            if full:
                steps.append((length, rank, full * each, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                leave(room - each * length, first, full)
            if full < n and left:  # fewer are left than one bin takes
                steps.append((length, rank, left, each, first + full, capacity - room))
                leave(room - left * length, first + full, 1)
                full, left = full + 1, 0
            leave(room, first + full, n - full)
    return steps, bins


class _Ids(dict):
    """chunk without white space -> its ids as little-endian unsigned 32-bit bytes, found on first sight.

    Chunks of printable ASCII, which are nearly all, are cut into pre-tokens here, by the ASCII part of the
    tokenizer's own pattern, and the ids of each distinct pre-token come once from its model. All others go to the
    library whole.
    """

    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isprintable() and "<|" not in chunk:
            out, words = b"", self.words
            for w in self.WORDS.findall(chunk.lower()):
                if (x := words.get(w)) is None:
                    x = words[w] = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(w))
                out += x
        else:
            out = self.ids(chunk)
        self[chunk] = out
        return out

    def trim(self) -> None:
        if len(self) > DICTIONARY_SIZE:
            self.clear()
        if len(self.words) > DICTIONARY_SIZE:
            self.words.clear()


_KEPT: dict[str, _Ids] = {}


def tokenised_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document with ``end_id`` after it: place, length, CRC-32 of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if path not in _KEPT:
                _KEPT.clear()
                _KEPT[path] = _Ids(path)
            ids = _KEPT[path]
            rows = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if _ODD.search(text):
                    data = ids.ids(text)
                else:  # the patterns of the tokenizer never cross white space
                    chunks = text.split()
                    ids.trim()
                    data = b"".join(map(ids.__getitem__, chunks))
                data += end_id.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for column, x in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def ranked(pieces: DataFrame) -> DataFrame:
    """``part`` and ``at``: a partition, and the place from 0 among the partition's rows of the same length."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            at = []
            for n in batch.column(3).to_pylist():
                at.append(seen.get(n, 0))
                seen[n] = at[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], names=[*batch.schema.names[:5], "part", "at"])

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pieces.repartitionByRange(n, F.col("length"), F.xxhash64("doc_id", "piece", "ids_crc32"))
    return spread.mapInArrow(number, f"{PIECES}, part int, at long")


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens by best-fit decreasing.

    Null text is an empty document (its end id alone); a null id is kept; repeated rows are packed once each; an
    empty table gives an empty result; other columns are ignored. Documents longer than a sequence are cut, others
    never. One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    pieces = written(tokenised_pieces(docs, id_col, text_col, capacity, tokenizer or public_tokenizers.path("word_bpe_49k.json")), "pieces")
    spread = written(ranked(pieces), "pieces-ranked")
    # A row for each pair of a partition and a length; as the partitions are ranges of lengths, partitions + lengths rows at most.
    before: dict[tuple[int, int], int] = {}
    total: dict[int, int] = {}
    for r in sorted(spread.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["length"], r["part"])):
        before[r["length"], r["part"]] = total.get(r["length"], 0)
        total[r["length"]] = total.get(r["length"], 0) + r["n"]
    # The plan's size is bounded by the capacity (open ranges: four for each length at most), not by the rows.
    plan: dict[int, list] = {}
    for length, *step in best_fit_plan(total, capacity)[0]:
        plan.setdefault(length, []).append(step)
    shared = spark.sparkContext.broadcast(({k: np.asarray(v, np.int64) for k, v in plan.items()}, before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps_of, first_of = shared.value
        for batch in batches:
            length, part, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5, 6))
            bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length).tolist():
                mine = np.flatnonzero(length == one)
                rank = at[mine] + np.array([first_of[one, p] for p in part[mine].tolist()], np.int64)
                steps = steps_of[one]
                step = steps[np.searchsorted(steps[:, 0], rank, "right") - 1]
                j = rank - step[:, 0]
                bins[mine] = step[:, 3] + j // step[:, 2]
                offset[mine] = step[:, 4] + j % step[:, 2] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return spread.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read_table(spark, sf_dir, "documents"))
