"""Removal of byte strings that documents with smaller ids hold too, on Burrows-Wheeler intervals.

A document's windows are its byte strings of the threshold length. Every window has an anchor: the byte string of
fixed length inside it whose hash is least (the left-most of equals). That depends on the window's bytes alone, so
equal windows have equal anchors at equal places and only occurrences of one anchor need to meet.

1. Exact copies of a text are found by digest first; those that are not the first take no further part.
2. A window holds, beside its anchor, half of the other bytes or more on one side of it. Hashes of the anchor with
   such a side (32 bits, within a bucket of anchors; an equal pair by chance only costs work) are asked for, packed by
   block of documents and bucket; a block learns which of them another document has too.
3. Documents with such sides give the stretches of text whose windows they belong to. A block gives each stretch
   once, with its least document id.
4. The stretches of an anchor meet in one task and are joined into one text. Its suffixes are sorted, and the bytes
   before them are its Burrows-Wheeler transform. Starting from the intervals of single bytes, each round extends all
   intervals backwards by one byte, through ranks on the transform, and so finds where the common prefix of two
   neighbours has just the next length; rounds end at the threshold. What no round has parted is one window string,
   and its least document id keeps it.
5. A stretch's first document is told which of the stretch's windows it keeps. All other windows of the stretches of
   step 3 are in a smaller document too: their bytes go.

An anchor with very many different stretches (a common line in ever new contexts) is dealt out: its stretches go to
as many tasks as they need, each expands its own intervals, and the least ids of equal windows are then aggregated
over the tasks with map-side partials.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, released, written
from .hashing import _powers, mixed, text_blocks

ANCHOR = 20
#: Blocks of text whose sides are asked for together, and bytes of text for each bucket of anchors.
BLOCKS, BUCKET_BYTES = 8, 64 << 20
#: Stretches that are worked on at once, in whole groups, and those that one group of an anchor may have.
BATCH, GROUP = 32_768, 8_192
#: Windows of a stretch: their flags fit in an int.
PIECE = 31
#: Low bits of the numbers by which anchors are chosen hold the place, the others the hash; no text has so many bytes.
_PLACE = np.uint64(31)


def content_hash(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of places a, b that hashes the bytes from each a to before b, the same in whatever text they stand."""
    n = len(data)
    powers, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=prefix[1:])
    return lambda a, b: mixed((prefix[b] - prefix[a]) * inverse[a])


def anchored(data: np.ndarray, bounds: np.ndarray, length: int, part: Callable) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, anchor place, first window, last window, left, right) of each maximal run of windows with one anchor.

    ``left``, ``right``: keys of the anchor with half of a window's other bytes before it and with the others after
    it, as far as one of the run's windows holds them; else a value of its own.
    """
    n, w = len(data), length - ANCHOR + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    assert n < 1 << int(_PLACE)
    h = part(slice(0, n - ANCHOR + 1), slice(ANCHOR, n + 1))
    least = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= w:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if w > step:
        least = np.minimum(least[: len(least) - (w - step)], least[w - step :])
    at = (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)  # anchor of the window from each place on
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    valid = np.arange(len(at)) + length <= bounds[1:][row]
    change = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    start, end = valid.copy(), valid.copy()
    start[1:] &= ~valid[:-1] | change
    end[:-1] &= ~valid[1:] | change
    s0, s1 = np.flatnonzero(start), np.flatnonzero(end)
    place, half = at[s0], (length - ANCHOR) // 2
    before = place - s0 >= half
    after = s1 + length - place - ANCHOR >= length - ANCHOR - half
    lone = mixed(h[place] + mixed((s0 - bounds[row[s0]]).astype(np.uint64)))  # the same in whatever block a text stands
    left = np.where(before, part(np.maximum(place - half, 0), place + ANCHOR), lone)
    right = np.where(after, part(place, np.minimum(place + length - half, n)), mixed(lone + np.uint64(1)))
    return row[s0], h[place], place, s0, s1, left >> np.uint64(32), right >> np.uint64(32) | _AFTER


_AFTER = np.uint64(1 << 32)  # marks the key of the side after the anchor
_LOW = np.uint64(0xFFFFFFFF)
_KEY_BITS = np.uint64(34)


def _new(*sorted_: np.ndarray) -> np.ndarray:
    """Whether each entry differs from the one before it in one of the arrays."""
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return new


def _held_by_many(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry whether its key stands with two different ``doc``."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    first = np.flatnonzero(_new(k))
    last = np.r_[first[1:], len(k)] - 1
    out = np.empty(len(k), bool)
    out[order] = np.repeat(d[first] != d[last], last - first + 1)
    return out


_ASKED = "bucket int, block long, kind int, owner binary, keys binary, ids array<long>"
_OPEN, _HALF, _KNOWN, _DONE, _IDS = range(5)


def _asked(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Packed rows of a block of documents for a bucket of anchors. ``owner``: places of documents in the block.

    Kind _OPEN: left and right keys to be looked up, each pair in one number; _HALF: keys to be looked up without the
    other of the pair. _DONE: keys that another document of the block has too, an answer already. _KNOWN: those keys,
    once for each block, so that a common line is a row per block. _IDS: the block's document ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts: list[tuple] = []
            for at, data, bounds in text_blocks(batch.column(1)):
                row, h, _, _, _, left, right = anchored(data, bounds, length, content_hash(data))
                parts.append((row + at, (h % np.uint64(buckets)).astype(np.int64), left, right))
                if len(parts) == BLOCKS:
                    yield from block(ids, parts)
                    parts = []
            yield from block(ids, parts)

    def block(ids: np.ndarray, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        row, bucket, left, right = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        if not len(row):
            return
        order = np.lexsort((right, left, row, bucket))
        order = order[_new(bucket[order], row[order], left[order], right[order])]
        row, bucket, left, right = row[order], bucket[order], left[order], right[order]
        own, row = np.unique(row, return_inverse=True)
        ids = ids[own]
        name = int(mixed(np.array([np.bitwise_xor.reduce(mixed(ids.astype(np.uint64) + mixed(np.arange(len(ids), dtype=np.uint64) * np.uint64(buckets + 1)))) + np.uint64(len(left))]))[0].astype(np.int64))
        many = _held_by_many(np.r_[left, right], np.r_[row, row])
        many_left, many_right = many[: len(left)], many[len(left) :]
        open_ = ~(many_left | many_right)
        rows = _packed(_OPEN, name, bucket[open_], row[open_], left[open_] << np.uint64(32) | right[open_] & _LOW)
        half_left, half_right = many_right & ~many_left, many_left & ~many_right
        of = np.r_[np.flatnonzero(half_left), np.flatnonzero(half_right)]
        half = np.r_[left[half_left], right[half_right]]
        order = np.lexsort((row[of], bucket[of]))
        rows += _packed(_HALF, name, bucket[of][order], row[of][order], half[order])
        known = np.unique(np.r_[left[many_left] | bucket[many_left].astype(np.uint64) << _KEY_BITS, right[many_right] | bucket[many_right].astype(np.uint64) << _KEY_BITS])
        rows += _packed(_KNOWN, name, (known >> _KEY_BITS).astype(np.int64), None, known & ((np.uint64(1) << _KEY_BITS) - np.uint64(1)))
        rows.append((abs(name) % buckets, name, _DONE, np.r_[row[many_left], row[many_right]].astype("<u4").tobytes(), np.r_[left[many_left], right[many_right]].astype("<u8").tobytes(), None))
        rows.append((abs(name) % buckets, name, _IDS, None, None, ids.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], names=["bucket", "block", "kind", "owner", "keys", "ids"])

    return docs.mapInArrow(run, _ASKED)


def _packed(kind: int, name: int, bucket: np.ndarray, owner: np.ndarray | None, keys: np.ndarray) -> list[tuple]:
    edges = [*np.flatnonzero(_new(bucket)).tolist(), len(bucket)]
    pack = lambda x, t: x.astype(t).tobytes()
    return [(int(bucket[a]), name, kind, None if owner is None else pack(owner[a:b], "<u4"), pack(keys[a:b], "<u8"), None) for a, b in zip(edges, edges[1:])]


def _answers(table: pa.Table) -> pa.Table:
    """Of one bucket: block, owner, keys: those keys of its open sides which another document has too; what else is known passes."""
    blocks, kinds, owners, packed = (table.column(c).to_pylist() for c in ("block", "kind", "owner", "keys"))
    keys = [None if x is None else np.frombuffer(x, "<u8") for x in packed]
    known = [i for i, k in enumerate(kinds) if k == _KNOWN]
    out = [(blocks[i], owners[i], packed[i]) for i, k in enumerate(kinds) if k == _DONE]
    open_ = []
    for i, k in enumerate(kinds):
        if k in (_OPEN, _HALF):
            owner = np.frombuffer(owners[i], "<u4").astype(np.int64)
            open_.append((blocks[i], owner, keys[i]) if k == _HALF else (blocks[i], np.r_[owner, owner], np.r_[keys[i] >> np.uint64(32), keys[i] & _LOW | _AFTER]))
    if open_:
        # A document is a number of its own, the same in a block's two rows; known keys of a block are two documents.
        width = 1 + max(int(x.max()) for _, x, _ in open_)
        number = {x: i for i, x in enumerate(dict.fromkeys(x for x, _, _ in open_))}
        doc = np.concatenate([x + number[name] * width for name, x, _ in open_])
        there = [np.zeros(0, np.uint64), *(keys[i] for i in known)]
        several = np.concatenate([*there, *there])
        half = np.arange(len(several)) < len(several) // 2
        hit = _held_by_many(np.concatenate([*(x for _, _, x in open_), several]), np.r_[doc, np.where(half, -1, -2)])
        at = 0
        for name, owner, key in open_:
            mine = hit[at : at + len(key)]
            at += len(key)
            if mine.any():
                out.append((name, owner[mine].astype("<u4").tobytes(), key[mine].astype("<u8").tobytes()))
    ids = [(b, x) for b, x, k in zip(blocks, table.column("ids").to_pylist(), kinds) if k == _IDS]
    columns = ([*(x[0] for x in out), *(b for b, _ in ids)], [*(x[1] for x in out), *(None for _ in ids)], [*(x[2] for x in out), *(None for _ in ids)], [*(None for _ in out), *(x for _, x in ids)])
    return pa.table({n: pa.array(x, t) for n, x, t in zip(("block", "owner", "keys", "ids"), columns, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))})


def _by_document(table: pa.Table) -> pa.Table:
    """Of one block: doc_id and its keys."""
    ids = next((x for x in table.column("ids").to_pylist() if x is not None), [])
    packed = [(a, b) for a, b in zip(table.column("owner").to_pylist(), table.column("keys").to_pylist()) if a]
    owner = np.frombuffer(b"".join(a for a, _ in packed), "<u4").astype(np.int64)
    keys = np.frombuffer(b"".join(b for _, b in packed), "<u8")
    order = np.lexsort((keys, owner))
    order = order[_new(owner[order], keys[order])] if len(order) else order
    owner, keys = owner[order], keys[order]
    edges = [*np.flatnonzero(_new(owner)).tolist(), len(owner)] if len(owner) else []
    return pa.table({"doc_id": pa.array([ids[owner[a]] for a in edges[:-1]], pa.int64()), "keys": pa.array([keys[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())})


def _told(batch_rows: pa.Array, at: int, n: int) -> np.ndarray:
    """Row and key in one number, of rows ``at`` to ``at + n`` of an array<binary> column; sorted."""
    row, keys = [], []
    for i, told in enumerate(batch_rows[at : at + n]):
        if told.is_valid:
            for x in told.as_py():
                keys.append(np.frombuffer(x, "<u8"))
                row.append((i, len(keys[-1])))
    if not keys:
        return np.zeros(0, np.uint64)
    i, count = np.array(row).T
    return np.unique(np.repeat(i.astype(np.uint64), count) << _KEY_BITS | np.concatenate(keys))


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def stretches(data: np.ndarray, bounds: np.ndarray, told: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, cid) of the runs of windows whose side is among the keys ``told``.

    ``cid`` is a hash of a stretch's bytes and of the anchor's place in it. No stretch has more than PIECE windows.
    """
    part = content_hash(data)
    row, h, place, s0, s1, left, right = anchored(data, bounds, length, part)
    code = row.astype(np.uint64) << _KEY_BITS
    has_left, has_right = _among(code | left, told), _among(code | right, told)
    middle = place - (length - ANCHOR) // 2  # windows up to here hold the left side, later ones the right side
    s0 = np.where(has_left, s0, np.maximum(s0, middle + 1))
    s1 = np.where(has_right, s1, np.minimum(s1, middle))
    keep = (has_left | has_right) & (s0 <= s1)
    row, h, place, s0, s1 = (x[keep] for x in (row, h, place, s0, s1))
    pieces = (s1 - s0) // PIECE + 1
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    row, h, place, s0, s1 = (np.repeat(x, pieces) for x in (row, h, place, s0, s1))
    s0 = s0 + PIECE * k
    s1 = np.minimum(s1, s0 + PIECE - 1)
    cid = mixed(part(s0, s1 + length) + mixed((place - s0 + length).astype(np.uint64) * np.uint64(PIECE + 1) + (s1 - s0).astype(np.uint64)))
    return row, h, s0, s1, cid


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """Of (doc_id, text, told): anchor, cid, stretch, doc_id; each stretch once for a block of text, with its least document."""
    schema = "anchor long, cid long, stretch binary, doc_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, data, bounds in text_blocks(batch.column(1)):
                row, h, s0, s1, cid = stretches(data, bounds, _told(batch.column(2), at, len(bounds) - 1), length)
                if not len(row):
                    continue
                doc = ids[at + row]
                order = np.lexsort((doc, cid, h))
                order = order[_new(cid[order], h[order])]
                raw = data.tobytes()
                parts = [raw[a:b] for a, b in zip(s0[order].tolist(), (s1[order] + length).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[order].view(np.int64)), pa.array(cid[order].view(np.int64)), pa.array(parts, pa.binary()), pa.array(doc[order])], names=["anchor", "cid", "stretch", "doc_id"])

    return docs.mapInArrow(run, schema)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of the cyclic ``text``, sorted by their first ``depth`` bytes or more (prefix doubling)."""
    n = len(text)
    around = np.resize(text, n + 8).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | around[i : i + n]
    known = 8
    while True:
        order = np.argsort(key)
        new = _new(key[order])
        if known >= depth or new.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        key = rank * np.uint64(n + 1) + np.roll(rank, -known)
        known *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``order``, up to ``least``.

    Lengths are found by increasing value. Let the neighbours i - 1 and i begin with the same byte; without it they are
    rows j < k of the order, which follow from the byte's ranks on the transform. Their common prefix is one more than
    the least between j and k: it is ``value`` if a boundary below ``value`` lies there, and no earlier round found one.
    """
    transform = text[order - 1]
    back = np.argsort(transform, kind="stable")
    first = transform[back]
    found = np.full(len(text), least)
    found[:1] = 0
    found[1:][first[1:] != first[:-1]] = 0
    open_ = np.flatnonzero(found == least)
    for value in range(1, least):
        if not len(open_):
            break
        interval = np.cumsum(found < value, dtype=np.int32)
        parted = interval[back[open_]] != interval[back[open_ - 1]]
        found[open_[parted]] = value
        open_ = open_[~parted]
    return found


def expand(parts: list[bytes], first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, start, least) of every window of the ``parts``: the least ``first`` of the parts that hold it too."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(x) for x in parts])
    begin = np.cumsum(sizes) - sizes
    windows = np.maximum(0, sizes - length + 1)
    part = np.repeat(np.arange(len(parts)), windows)
    start = begin[part] + np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(part):
        return part, start, part
    order = suffix_order(text, length)
    name = np.empty(len(text), np.int64)  # of the string of ``length`` bytes from each place on
    name[order] = np.cumsum(common_prefixes(text, order, length) < length)
    by = np.argsort(name[start], kind="stable")
    new = _new(name[start][by])
    least = np.empty(len(by), np.int64)
    least[by] = np.minimum.reduceat(first[part][by], np.flatnonzero(new))[np.cumsum(new) - 1]
    return part, start, least


def _expanded(rows: DataFrame, length: int) -> DataFrame:
    """Of (anchor, cid, stretch, doc_id, groups), in partitions and order of their anchors and groups: doc_id, cid, flags, window.

    A row tells a document which windows of the stretch ``cid`` it keeps. Where the anchor has several groups, rows
    have a window, its hash as ``cid`` and the least document of the group.
    """
    schema = "doc_id long, cid long, flags int, window binary"

    def once(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """Each stretch once, with its least document; whether a new group starts."""
        anchor, cid, doc, salt = (rows.column(c).to_numpy() for c in ("anchor", "cid", "doc_id", "salt"))
        order = np.lexsort((doc, cid, salt, anchor))
        order = order[_new(anchor[order], salt[order], cid[order])]
        return rows.take(pa.array(order)), _new(anchor[order], salt[order])

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, new = once(rows)
        cid, doc, groups = (rows.column(c).to_numpy() for c in ("cid", "doc_id", "groups"))
        edges = np.r_[np.flatnonzero(new), len(new)]
        alone = np.repeat(np.diff(edges) == 1, np.diff(edges)) & (groups == 1)
        windows = pc.binary_length(rows.column("stretch")).to_numpy().astype(np.int64) - length + 1
        flags = np.where(alone, (1 << windows) - 1, 0)
        several = np.flatnonzero(~alone)
        if len(several):
            parts = rows.column("stretch").take(pa.array(several)).to_pylist()
            part, start, least = expand(parts, doc[several], length)
            here = several[part]
            k = start - np.r_[start[:1], start[1:]][np.searchsorted(part, part)]
            mine = (least == doc[here]) & (groups[here] == 1)
            flags += np.bincount(here, np.where(mine, np.int64(1) << k, 0), len(flags)).astype(np.int64)
            split = np.flatnonzero(groups[here] > 1)
            if len(split):
                text = np.frombuffer(b"".join(parts), np.uint8)
                key = content_hash(text)(start[split], start[split] + length)
                order = np.lexsort((least[split], key))
                split, key = split[order], key[order]
                some = _new(key, least[split])
                raw, split, key = text.tobytes(), split[some], key[some]
                yield batch(least[split], key.view(np.int64), np.zeros(len(split), np.int64), [raw[a : a + length] for a in start[split].tolist()])
        kept = np.flatnonzero(flags)
        yield batch(doc[kept], cid[kept], flags[kept], [None] * len(kept))

    def batch(doc: np.ndarray, cid: np.ndarray, flags: np.ndarray, window: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(cid, pa.int64()), pa.array(flags.astype(np.int32)), pa.array(window, pa.binary())], names=["doc_id", "cid", "flags", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows >= BATCH:  # all but the last group, which may go on
                anchor, salt = held.column("anchor").to_numpy(), held.column("salt").to_numpy()
                cut = int(np.flatnonzero(_new(anchor, salt))[-1])
                if cut:
                    yield from done(held.slice(0, cut))
                held = once(held.slice(cut))[0].combine_chunks()
        if held is not None:
            yield from done(held)

    return rows.mapInArrow(run, schema)


def shared_sides(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Of (doc_id, text): doc_id and the keys of its sides that another document has too."""
    reply = _asked(docs, length, buckets).groupBy("bucket").applyInArrow(_answers, "block long, owner binary, keys binary, ids array<long>")
    return reply.groupBy("block").applyInArrow(_by_document, "doc_id long, keys binary").groupBy("doc_id").agg(F.collect_list("keys").alias("told"))


def kept_windows(found: DataFrame, length: int, partitions: int) -> DataFrame:
    """Of (anchor, cid, stretch, doc_id): doc_id, cid, flags: the windows that a document keeps (see :func:`_expanded`)."""
    large = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP), "large-anchors")
    dealt = found.join(large, "anchor", "left").withColumn("groups", F.ceil(F.coalesce("n", F.lit(1)) / GROUP).cast("int")).drop("n")
    dealt = dealt.withColumn("salt", F.pmod("cid", "groups").cast("int")).repartition(partitions, "anchor", "salt").sortWithinPartitions("anchor", "salt")
    out = written(_expanded(dealt, length), "kept-windows")
    released(large)
    of_groups = out.filter("window is not null").groupBy("cid", "window").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "cid", F.lit(0).alias("flags"))
    return out.filter("window is null").drop("window").unionByName(of_groups)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """doc_id, told, kept, copies: what :func:`cut_documents` has to know of documents that share a window.

    ``told``: keys of sides; ``kept``: (cid, flags) of the windows that no smaller document has; ``copies``: digests of
    the texts under that id of which a smaller document is an exact copy. A table in the shared folder.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    named = named.withColumn("sha", F.unhex(F.sha2("text", 256)))
    digest = written(named.select("doc_id", "sha", F.octet_length("text").cast("long").alias("size")), "digests")
    firsts = digest.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    copies = written(digest.select("doc_id", "sha").distinct().join(firsts, ["doc_id", "sha"], "left_anti"), "copies")
    total = digest.agg(F.sum("size")).first()[0] or 0
    released(digest)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    firsts = named.join(copies, ["doc_id", "sha"], "left_anti").select("doc_id", "text")
    told = written(shared_sides(firsts, length, partitions), "shared-sides")
    found = written(_stretches(named.select("doc_id", "text").join(told.hint("shuffle_hash"), "doc_id"), length), "stretches")
    kept = written(kept_windows(found, length, partitions).groupBy("doc_id").agg(F.collect_list(F.struct("cid", "flags")).alias("kept")), "kept")
    released(found)
    by_id = copies.groupBy("doc_id").agg(F.collect_list("sha").alias("copies"))
    out = written(told.join(kept, "doc_id", "left").join(by_id, "doc_id", "full"), "repeated-windows")
    released(told, kept, copies)
    return out


def cut_block(data: np.ndarray, bounds: np.ndarray, told: np.ndarray, kept: tuple[np.ndarray, ...], length: int) -> np.ndarray:
    """Whether each byte of the block goes. ``kept``: row, cid and flags."""
    row, _, s0, s1, cid = stretches(data, bounds, told, length)
    whose, names, flags = kept
    key = lambda row, cid: mixed(cid + mixed(row.astype(np.uint64)))
    order = np.argsort(theirs := key(whose, names))
    theirs, flags = theirs[order], flags[order]
    stay = np.zeros(len(row), np.int64)
    if len(theirs):
        at = np.minimum(np.searchsorted(theirs, mine := key(row, cid)), len(theirs) - 1)
        stay = np.where(theirs[at] == mine, flags[at].astype(np.int64), 0)
    windows = s1 - s0 + 1
    k = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start = np.repeat(s0, windows) + k
    go = np.repeat(stay, windows) >> k & 1 == 0
    if (flags == 0).any():  # windows of anchors in several groups are named one by one
        go &= ~_among(key(np.repeat(row, windows), content_hash(data)(start, start + length)), theirs[flags == 0])
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, start[go], 1)
    np.add.at(edge, start[go] + length, -1)
    return np.cumsum(edge[:-1]) > 0


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, texts: bool = True) -> DataFrame:
    """doc (a struct of the columns other than the text), n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``,
    kept (the bytes that are left) and kept_text (of those, whole characters; null where the text is), for every row of ``docs``.

    Bytes go that windows of ``length`` bytes cover which also start in a document with a smaller id. Null texts are
    empty and, like texts shorter than a window, are never touched; nor are rows with a null id. A repeated row is no
    smaller document than itself, so both stay; texts that share an id are not compared with each other. Extra columns
    pass through in ``doc``, whatever their names.
    """
    known = repeated_windows(docs, id_col, text_col, length)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*rest).alias("doc"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    joined = rows.filter("id is not null").join(known.withColumnRenamed("doc_id", "id").hint("shuffle_hash"), "id", "left")
    whole = F.coalesce(F.when(F.col("copies").isNotNull(), F.array_contains("copies", F.unhex(F.sha2("text", 256)))), F.lit(False))
    joined = joined.select("doc", "text", "told", "kept", whole.alias("whole"))
    nameless = rows.filter("id is null").select("doc", "text", *(F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in ("told", "kept")), F.lit(False).alias("whole"))
    schema = T.StructType([T.StructField("doc", joined.schema["doc"].dataType)])
    for name, kind in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), *((("kept", T.BinaryType()), ("kept_text", T.StringType())) if texts else ())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("whole").to_numpy(zero_copy_only=False)
            for at, data, bounds in text_blocks(batch.column("text")):
                n = len(bounds) - 1
                told = _told(batch.column("told"), at, n)
                gone = np.zeros(len(data), bool)
                if len(told):
                    lists = batch.column("kept").slice(at, n).fill_null([])
                    flat = lists.flatten()
                    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                    gone = cut_block(data, bounds, told, (row, flat.field("cid").to_numpy().view(np.uint64), flat.field("flags").to_numpy()), length)
                gone |= np.repeat(whole[at : at + n], np.diff(bounds))
                begins = gone.copy()
                begins[1:] &= ~gone[:-1] | np.isin(np.arange(1, len(data)), bounds) if len(data) else True
                sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][bounds])  # noqa: E731, B023
                lost = sums(gone)
                left, edges = data[~gone].tobytes(), np.r_[0, np.cumsum(np.diff(bounds) - lost)].tolist()
                kept = [left[a:b] for a, b in zip(edges, edges[1:])]
                columns = [batch.column("doc").slice(at, n), pa.array(np.diff(bounds)), pa.array(lost), pa.array(sums(begins)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                if texts:
                    absent = batch.column("text").slice(at, n).is_null().to_numpy(zero_copy_only=False)
                    columns += [pa.array(kept, pa.binary(), mask=absent), pa.array([x.decode(errors="ignore") for x in kept], pa.string(), mask=absent)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.unionByName(nameless).mapInArrow(run, schema)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_documents(docs, texts=False).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
