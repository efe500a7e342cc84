"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The compiled transducer has three kinds of arcs: the normaliser's (a space becomes the mark U+2581, and one mark
leads a text), one path for every piece, and the byte fallback of every character that is no piece. An input is
composed with it chunk by chunk (no piece has a mark after another character, so no arc crosses into a chunk), which
gives a lattice of pieces, and the shortest path in the tropical semiring is taken through it.

For a byte-pair model the weight of two arcs in a row is 0 if merging their joined characters gives just these
two pieces, and infinite otherwise. A sequence of pieces is what merging gives for the whole if and only if that
holds for each two neighbours, and each prefix has one such sequence; so the shortest path is the model's own
encoding, not an approximation by scores. For a unigram model the weight of an arc is minus the piece's score.
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

from .common import read_table

MARK = "▁"
INFINITE = float("inf")
#: Entries after which a worker's tables of chunks, of their parts and of neighbours start anew.
CHUNKS, PARTS, NEIGHBOURS = 250_000, 800_000, 400_000
UNIGRAM, BPE, NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 1, 2, 3, 6


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm, self.bpe = model.normalizer_spec, model.trainer_spec.model_type == BPE
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped spaces is compiled")
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or not model.trainer_spec.byte_fallback:
            raise ValueError("only unigram and byte-pair models with byte fallback are compiled")
        self.lead = MARK if norm.add_dummy_prefix else ""
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.parts: dict[str, bytes] = {}
        self.packed = {p: i.to_bytes(4, "little") for p, (i, _) in self.pieces.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        #: All ends of pieces: a stretch that is none of them is no end of a longer piece either.
        self.tails = {p[i:] for p in self.pieces for i in range(len(p))}
        self.crossed = any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type in (UNKNOWN, CONTROL) else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.neighbours: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """What merging gives: the pair with the best piece first, of equal ones the left-most."""
        parts, pieces = list(text), self.pieces
        none = (0, -INFINITE)
        scores = [pieces.get(a + b, none)[1] for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != -INFINITE:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = pieces.get(parts[i] + parts[i + 1], none)[1]
            if i:
                scores[i - 1] = pieces.get(parts[i - 1] + parts[i], none)[1]
        return parts

    def weight(self, left: str, right: str) -> float:
        """Of the arc ``right`` after the arc ``left`` (empty: the start)."""
        if not self.bpe:
            return -self.pieces[right][1] if right in self.pieces else 1e6
        known = self.neighbours.get((left, right))
        if known is None:
            if len(self.neighbours) > NEIGHBOURS:
                self.neighbours.clear()
            known = self.neighbours[left, right] = self.merged(left + right) == [x for x in (left, right) if x]
        return 0.0 if known else INFINITE

    def compose(self, text: str) -> list[list[tuple[int, str]]]:
        """The lattice: for each place from 1 on, the arcs (start, piece) that end there, shortest first."""
        pieces, tails, out = self.pieces, self.tails, []
        for end in range(1, len(text) + 1):
            start = end - 1
            p = text[start:end]
            arcs = [(start, p)]  # a character that is no piece falls back to its bytes
            while start and (p := text[(start := start - 1) : end]) in tails:
                if p in pieces:
                    arcs.append((start, p))
            out.append(arcs)
        return out

    def shortest_path(self, lattice: list[list[tuple[int, str]]]) -> list[str]:
        """Of least total weight. In a byte-pair model each place has one path of finite length, so the first arc that
        fits, from the longest on, is the shortest path to its end."""
        if not self.bpe:
            return self._relaxed(lattice)
        last: list[str | None] = [""]
        back, known = [0], self.neighbours
        for arcs in lattice:
            for start, piece in reversed(arcs):
                left = last[start]
                if left is not None:
                    fits = known.get((left, piece))
                    if fits is None:
                        fits = self.weight(left, piece) == 0.0
                    if fits:
                        last.append(piece)
                        back.append(start)
                        break
            else:
                last.append(None)
                back.append(0)
        out, at = [], len(lattice)
        while at > 0:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _relaxed(self, lattice: list[list[tuple[int, str]]]) -> list[str]:
        distance, via = [0.0], [(0, "")]
        for arcs in lattice:
            best, arc = INFINITE, (0, "")
            for start, piece in reversed(arcs):
                if (d := distance[start] + self.weight(via[start][1], piece)) < best:
                    best, arc = d, (start, piece)
            distance.append(best)
            via.append(arc)
        out, at = [], len(lattice)
        while at > 0:
            at, piece = via[at]
            out.append(piece)
        return out[::-1]

    def ids(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        return [known[0]] if known else [self.bytes[b] for b in piece.encode()]

    def encode_chunk(self, chunk: str) -> bytes:
        """Cut where no piece has the two characters next to each other, so that no arc crosses; each part once."""
        joined, parts, out, at = self.joined, self.parts, [], 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in joined:
                part = chunk[at:i]
                if (x := parts.get(part)) is None:
                    if len(parts) > PARTS:
                        parts.clear()
                    x = parts[part] = self._encode_part(part)
                out.append(x)
                at = i
        return b"".join(out)

    def _encode_part(self, part: str) -> bytes:
        return b"".join([x if (x := self.packed.get(p)) is not None else b"".join(i.to_bytes(4, "little") for i in self.ids(p)) for p in self.shortest_path(self.compose(part))])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        text = self.lead + text.replace(" ", MARK)
        if self.crossed:
            return self.encode_chunk(text)
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        if text[0] == MARK and MARK + MARK not in text:
            parts = [MARK + x for x in text[1:].split(MARK)]
        else:
            parts = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)
        known = self.chunks
        for p in set(parts).difference(known):
            known[p] = self.encode_chunk(p)
        return b"".join(map(known.__getitem__, parts))

    def decode(self, ids: bytes) -> str:
        """The inverse: pieces to their surfaces, byte ids to bytes, without the leading space."""
        data = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (data[1:] if self.lead and data[:1] == b" " else data).decode("utf-8", "replace")


_KEPT: dict[str, Transducer] = {}


def _transducer(path: str) -> Transducer:
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Transducer(path)
    return _KEPT[path]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_bytes, ids: the ids of every whole text, as an array of int, without begin and end ids.

    Null text is empty and has no ids; repeated rows give repeated rows; an empty table gives an empty result;
    other columns are ignored.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _transducer(path)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = [t.encode(x) for x in texts]
                bounds = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), lists], names=["doc_id", "n_bytes", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_ids, n_byte_ids, ids_crc32, text: the texts of ids. Null ids give a null text."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _transducer(path)
            fallback = np.zeros(len(t.surface), bool)
            fallback[list(t.bytes.values())] = True
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [[], [], [], []]
                for x in part.column(2):
                    ids = x.values.to_numpy(zero_copy_only=False) if x.is_valid else None
                    data = None if ids is None else ids.astype("<u4").tobytes()
                    for column, y in zip(rows, (None,) * 4 if ids is None else (len(ids), int(fallback[ids].sum()), zlib.crc32(data), t.decode(data))):
                        column.append(y)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(x, k) for x, k in zip(rows, kinds))], names=["doc_id", "n_bytes", "n_ids", "n_byte_ids", "ids_crc32", "text"])

    return encoded.select("doc_id", "n_bytes", "ids").mapInArrow(run, "doc_id long, n_bytes long, n_ids long, n_byte_ids long, ids_crc32 long, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_pieces(encode_pieces(read_table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_bytes", "n_ids", "n_byte_ids", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))
