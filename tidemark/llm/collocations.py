"""Phrases mined from compressed position bitmaps of words, by shifting, intersecting and counting bits.

A shard is a stretch of the corpus of bounded size, cut between pieces. Its words stand at positions 0, 1, 2, ..., with
an empty position between two pieces; a word of a language has a bitmap of its positions, of which only the 64-bit
blocks that hold a bit are kept. The bitmap of a phrase's last positions, shifted by one and intersected with a word's
bitmap, is that of the phrase with the word behind it; its bits are the phrase's occurrences in the shard. Words whose
bitmaps can't meet a shifted one are never tried: the lowest bit left of a block names the next word that does. Phrases
are extended depth-first, from a batch of first words to their longest phrases, before the next batch is begun.

Counts are summed over shards by an aggregation of what tasks have added up in arrays of bounded size. As a phrase is no
more frequent than its parts, words that are rare in the whole corpus are taken out of every shard, and longer phrases are
only begun where their pairs are frequent. Which words
are frequent is told by a broadcast table of their hashes, which pairs are by a Bloom filter of them, whose errors add
phrases that the sums then drop; shards then stay where they are. Where words or pairs are too many for that, it is told by
a join with those that each shard has. A word or pair has a row a shard at most in every join and sum, so the commonest
weighs no more than the number of shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .coding import byte_set, coded, row_blocks, text_bytes, word_spans
from .common import read_table, released, written
from .hashing import mixed

#: Bytes of text a shard, and entries of bitmaps that are extended at once; they bound memory and change no result.
SHARD_BYTES, BATCH = 3 << 20, 200_000
_BREAKS = byte_set(*b".,;:!?", (0x0A, 0x0D))
_SOLID = ~(_BREAKS | byte_set(0x20, 0x09))
_SHARDS = "shard long, positions long, codes binary, names array<struct<lang:string,word:string,n:bigint>>"
_ONE = np.uint64(1)
#: Shards that a Parquet row group holds and that go to Python at once, and entries that a task holds to add up equal pairs
#: before they are shuffled; they bound memory and change no result.
SHARDS_AT_ONCE, HELD = 2, 1 << 20
#: Documents that go to Python at once; shards are cut from them as they come.
DOCS_AT_ONCE = 256
#: Pairs up to which a filter of at most 16 MB tells the frequent ones; more are joined to the shards that have them.
FILTERED_PAIRS = 1 << 24
#: Frequent words up to which a table of at most 40 MB (two hashes and an id each) tells them; more are joined to the shards.
LISTED_WORDS = 1 << 21


class Bitmaps:
    """Bitmaps of positions by owner: for each owner its 64-bit blocks that hold a bit, in order of owner and block."""

    def __init__(self, owner: np.ndarray, block: np.ndarray, mask: np.ndarray):
        self.owner, self.block, self.mask = owner, block, mask

    @classmethod
    def merged(cls, owner: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[Bitmaps, np.ndarray]:
        """Bitmaps of entries in any order, and which of its blocks each entry went to."""
        n = int(block.max()) + 1 if len(block) else 1
        key = owner * n + block
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        went = np.empty(len(key), np.int64)
        went[order] = np.cumsum(np.bincount(first, minlength=len(key))) - 1 if len(key) else 0
        return cls(key[first] // n, key[first] % n, np.bitwise_or.reduceat(mask[order], first) if len(key) else mask), went

    def part(self, of: np.ndarray) -> Bitmaps:
        return Bitmaps(self.owner[of], self.block[of], self.mask[of])

    def counts(self, owners: int) -> np.ndarray:
        return np.bincount(self.owner, np.bitwise_count(self.mask), owners).astype(np.int64)


class Shard:
    """The words of a shard at their positions; ``codes`` are -1 where there is none."""

    def __init__(self, codes: np.ndarray):
        at = np.flatnonzero(codes >= 0)
        self.n = int(codes.max(initial=-1)) + 1
        self.words, went = Bitmaps.merged(codes[at].astype(np.int64), at >> 6, _ONE << (at & 63).astype(np.uint64))
        self.entry = np.full((len(codes) // 64 + 2) * 64, -1, np.int64)  # of each position, the block of its word
        self.entry[at] = went

    def extended(self, phrases: Bitmaps) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
        """(phrase, next word, bitmaps by their row): what ``phrases`` become with one more word."""
        carry = phrases.mask >> np.uint64(63)
        over = carry != 0
        owner, block = np.concatenate([phrases.owner, phrases.owner[over]]), np.concatenate([phrases.block, phrases.block[over] + 1])
        mask = np.concatenate([phrases.mask << _ONE, carry[over]])
        keys, blocks, masks = [], [], []
        while len(mask := mask[left := mask != 0]):
            owner, block = owner[left], block[left]
            low = mask & (~mask + _ONE)
            entry = self.entry[block * 64 + np.bitwise_count(low - _ONE)]
            met = entry >= 0
            both = mask & self.words.mask[entry]
            keys.append((owner * self.n + self.words.owner[entry])[met])
            blocks.append(block[met])
            masks.append(both[met])
            mask = mask ^ np.where(met, both, low)
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), phrases.part(np.zeros(0, np.int64))
        key, row = np.unique(np.concatenate(keys), return_inverse=True)
        return key // self.n, key % self.n, Bitmaps.merged(row, np.concatenate(blocks), np.concatenate(masks))[0]

    def mined(self, longest: int, pairs: np.ndarray | Callable | None = None, batch: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words of phrases of one length, their occurrences), depth-first; of two words only those in sorted ``pairs``
        (first << 32 | second), or of which ``pairs(first, second)`` is true, are gone on with if it is given."""
        cut = 0
        while cut < len(self.words.owner):
            to = min(cut + batch, len(self.words.owner))
            to = int(np.searchsorted(self.words.owner, self.words.owner[to - 1], "right"))  # a first word is in one batch
            level, names = self.words.part(slice(cut, to)), np.arange(self.n)[:, None]
            cut = to
            for _ in range(longest - 1):
                phrase, word, level = self.extended(level)
                names = np.column_stack([names[phrase], word])
                if pairs is not None:  # also the last two words of what is longer
                    last = names[:, -2], names[:, -1]
                    good = pairs(*last) if callable(pairs) else in_sorted(last[0] << 32 | last[1], pairs)
                    number = np.cumsum(good) - 1
                    level, names = level.part(good[level.owner]), names[good]
                    level.owner = number[level.owner]
                if not len(names):
                    break
                yield names, level.counts(len(names))


def in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, x)
    return (at < len(table)) & (table[np.minimum(at, max(len(table) - 1, 0))] == x) if len(table) else np.zeros(len(x), bool)


def _stretches(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of up to ``size`` bytes that end with a row or a piece; a longer piece is one of its own."""
    ends = np.union1d(bounds, np.flatnonzero(_BREAKS[data]) + 1)
    at = 0
    while at < len(data):
        to = int(ends[np.searchsorted(ends, at + size, "right") - 1])
        to = to if to > at else int(ends[np.searchsorted(ends, at, "right")])
        yield at, to
        at = to


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, text) a row for each shard: the codes of its positions, and its words of a language in order of code."""
    shard = TaskContext.get().partitionId() << 32
    names = [c.split()[0] for c in _SHARDS.split(", ")]  # no comma of a struct is followed by a space
    for table in row_blocks(batches, 1, size):
        langs = pc.fill_null(table.column(0).combine_chunks(), "und").dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        lang_of, k = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(langs.dictionary)
        data, bounds = text_bytes(table.column(1))
        for a, b in _stretches(data, bounds, size):
            rows = np.arange(np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b, "left"))
            own, edges = data[a:b], np.clip(bounds[rows[0] : rows[-1] + 2] - a, 0, b - a)
            starts, ends = word_spans(own, edges, _SOLID)
            words, code = coded(own, starts, ends, _SOLID)
            row = rows[0] + np.searchsorted(edges, starts, "right") - 1
            key = code * k + lang_of[row]
            seen = np.bincount(key, minlength=len(words) * k)
            have = np.flatnonzero(seen)
            number = np.cumsum(seen > 0) - 1
            piece = np.cumsum(_BREAKS[own])[starts] if len(starts) else starts
            gaps = np.cumsum(np.r_[0, (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])]) if len(starts) else starts
            codes = np.full(len(code) + int(gaps[-1]) if len(code) else 0, -1, np.int32)
            codes[np.arange(len(code)) + gaps] = number[key]
            shard, m = shard + 1, len(have)
            own_names = pa.StructArray.from_arrays([langs.dictionary.take(pa.array(have % k)), words.take(pa.array(have // k)).cast(pa.string()), pa.array(seen[have])], names=["lang", "word", "n"])
            row_names = pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), own_names)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(codes)]), pa.array([pa.compress(codes.tobytes(), "zstd", asbytes=True)], pa.binary()), row_names], names=names)


class Known:
    """The frequent words: two hashes of each, in order of the first, and their ids."""

    def __init__(self, one: pa.Table):
        h, check, ids = (one.column(c).to_numpy() for c in ("h", "check", "id"))
        order = np.argsort(h, kind="stable")
        self.h, self.check, self.ids = h[order], check[order], ids[order]

    @property
    def distinct(self) -> bool:
        return bool((self.h[1:] != self.h[:-1]).all())

    def of(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of those that are frequent words, their ids)."""
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        have = np.flatnonzero((self.h[at] == h) & (self.check[at] == check)) if len(self.h) else np.zeros(0, np.int64)
        return have, self.ids[at[have]]


def _open(batch: pa.RecordBatch, i: int, known: Broadcast | None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers by position of the frequent words, their ids) of a shard; -1 for all others."""
    column = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
    if known is None:
        of, ids = column("code").astype(np.int64), column("id")
    else:
        of, ids = known.value.of(column("h"), column("check"))
    n = batch.column("positions")[i].as_py()
    codes = np.frombuffer(pa.decompress(batch.column("codes")[i].as_py(), 4 * n, "zstd", asbytes=True), np.int32)
    number = np.full(max(int(codes.max(initial=-1)), int(of.max(initial=-1))) + 2, -1, np.int64)
    number[of] = np.arange(len(of))
    return number[codes], ids  # code -1 is the last place, which is -1


def summed(found: Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]], held: int) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """(columns of keys, counts) with equal keys added up, in their order, among about ``held`` of them at a time."""
    parts, n = [], 0

    def sums() -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        keys, count = [np.concatenate(c) for c in zip(*(k for k, _ in parts))], np.concatenate([c for _, c in parts])
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
        keys = [k[order] for k in keys]
        first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        return tuple(k[first] for k in keys), np.add.reduceat(count[order], first)

    for keys, count in found:
        if len(count):
            parts.append((keys, count))
            n += len(count)
        if n >= held:
            parts = [sums()]
            n = len(parts[0][1])
            if 2 * n >= held:  # few were equal
                yield parts[0]
                parts, n = [], 0
    if n:
        yield sums()


def _summed_batches(found: Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]], held: int, rows: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for keys, n in summed(found, held):
        for at in range(0, len(n), rows):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + rows]) for c in (*keys, n)], names=[*names, "n"])


def _pairs(shards: DataFrame, known: Broadcast | None, bits: int = 0) -> DataFrame:
    """(shard, first, second, n): the words' ids of each pair in a shard. With ``bits`` (pair, n), both ids in one number,
    added up over shards as far as :func:`summed` does."""
    at_once, held = BATCH, HELD

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, ids = _open(batch, i, known)
                pa.default_memory_pool().release_unused()  # what the shard before took
                for found, n in Shard(codes).mined(2, None, at_once):
                    yield batch.column("shard")[i].as_py(), ids[found[:, 0]], ids[found[:, 1]], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not bits:
            for shard, first, second, n in mined(batches):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), pa.array(first), pa.array(second), pa.array(n)], names=["shard", "first", "second", "n"])
            return
        yield from _summed_batches((((first << bits | second,), n) for _, first, second, n in mined(batches)), held, at_once, ["pair"])

    return shards.select("shard", "positions", "codes", *_found_by(known)).mapInArrow(run, "pair long, n long" if bits else "shard long, first long, second long, n long")


def _numbered(one: DataFrame) -> tuple[DataFrame, int]:
    """(the words with ids that hardly leave gaps, the bits of an id; 0 if two ids don't fit a number)."""
    part, row = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)  # as monotonically_increasing_id gives them
    parts, rows = ((x or 0) + 1 for x in one.agg(F.max(part), F.max(row)).first())
    bits = max(1, (parts * rows - 1).bit_length())
    return one.withColumn("id", part * rows + row), bits if 2 * bits < 64 else 0


def _frequent_pairs(shards: DataFrame, known: Broadcast | None, bits: int, least: int) -> DataFrame:
    """(first, second, a): pairs that occur ``least`` times. Of all shuffles theirs is the largest, so two ids go as one number,
    and tasks add up their own in NumPy, as Spark's table of groups would hold ten times as many bytes for a pair."""
    found = _pairs(shards, known, bits)
    sums = (found.repartition("pair").groupBy("pair") if bits else found.groupBy("first", "second")).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    return sums.select(F.shiftright("pair", bits).alias("first"), F.col("pair").bitwiseAND((1 << bits) - 1).alias("second"), "a") if bits else sums


def _found_by(known: Broadcast | None) -> list[str]:
    return ["code", "id"] if known is None else ["h", "check"]


def _places(first: np.ndarray, second: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of ``bits`` (a power of two up to 2^32) for each pair of ids."""
    h = mixed(mixed(first.view(np.uint64)) + second.view(np.uint64))
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def _filter(pairs: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter, in 64-bit words, of the pairs of ids: eight bits or more for each. Its words come to the driver."""
    bits = 1 << max(10, (8 * n - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)), bits))
            words = Bitmaps.merged(np.zeros(len(at), np.int64), at >> 6, _ONE << (at & 63).astype(np.uint64))[0]
            yield pa.RecordBatch.from_arrays([pa.array(words.block), pa.array(words.mask.view(np.int64))], names=["word", "mask"])

    found = pairs.select("first", "second").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out


def _packing(longest: int, bits: int) -> tuple[int, int, list[str]]:
    """(bits of a word's place in a number, words a number, columns) of phrases whose words' ids have ``bits`` (0: any)."""
    width = bits + 1 if bits else 63
    per = 63 // width
    return width, per, [f"k{j}" for j in range(-(-longest // per))]


def _packed(ids: np.ndarray, width: int, per: int, columns: int) -> tuple[np.ndarray, ...]:
    """Phrases, given by a row of ids, as ``columns`` numbers; an id counts one more there, as 0 is no word."""
    out = tuple(np.zeros(len(ids), np.int64) for _ in range(columns))
    for j in range(ids.shape[1]):
        out[j // per][:] |= ids[:, j] + 1 << width * (j % per)
    return out


def _longer(shards: DataFrame, longest: int, known: Broadcast | None, bits: int, words: Broadcast | None = None) -> DataFrame:
    """(the columns of :func:`_packing`, n) of the phrases of three and more words, added up over shards as far as
    :func:`summed` does, of pairs that the filter ``words`` has or, without one, that the column ``pairs`` lists."""
    at_once, held = BATCH, HELD
    width, per, columns = _packing(longest, bits)

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, ids = _open(batch, i, known)
                if words is None:
                    order = np.argsort(ids)
                    first, second = (order[np.searchsorted(ids[order], batch.column("pairs")[i].values.field(k).to_numpy(zero_copy_only=False))] for k in ("first", "second"))
                    good = np.sort(first << 32 | second)
                else:
                    has = words.value

                    def good(first: np.ndarray, second: np.ndarray) -> np.ndarray:
                        bits = _places(ids[first], ids[second], 64 * len(has))
                        return np.logical_and(*((has[p >> 6] >> (p & 63).astype(np.uint64) & _ONE).astype(bool) for p in bits))

                pa.default_memory_pool().release_unused()
                for found, n in Shard(codes).mined(longest, good, at_once):
                    if found.shape[1] > 2:
                        yield _packed(ids[found], width, per, len(columns)), n

    run = lambda batches: _summed_batches(mined(batches), held, at_once, columns)
    return shards.select("positions", "codes", *_found_by(known), *(["pairs"] if words is None else [])).mapInArrow(run, ", ".join(f"{c} long" for c in [*columns, "n"]))


def _frequent_longer(found: DataFrame, one: DataFrame, longest: int, bits: int, least: int) -> DataFrame:
    """(lang, phrase, size, a): phrases of :func:`_longer` that occur ``least`` times, with their words."""
    width, per, columns = _packing(longest, bits)
    sums = found.repartition(*columns).groupBy(*columns).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    ids = F.array(*(F.shiftright(columns[j // per], width * (j % per)).bitwiseAND((1 << width) - 1) for j in range(longest)))
    each = sums.select(*columns, "a", F.posexplode(ids).alias("at", "id")).filter("id > 0")
    named = each.join(one.select((F.col("id") + 1).alias("id"), "lang", "word"), "id").groupBy(*columns, "a")
    named = named.agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    return named.select("lang", F.concat_ws(" ", "words.word").alias("phrase"), F.size("words").alias("size"), "a")


def _hashes(lang: Column, word: Column) -> tuple[Column, Column]:
    return F.xxhash64(lang, word).alias("h"), F.hash(word, lang).alias("check")


def _known(one: DataFrame) -> Broadcast | None:
    """The frequent words for all tasks; none if they are more than ``LISTED_WORDS``, or two of them share their first hash."""
    if one.count() > LISTED_WORDS:
        return None
    known = Known(one.select("h", "check", "id").toArrow())
    return one.sparkSession.sparkContext.broadcast(known) if known.distinct else None


def _joined(table: DataFrame, one: DataFrame) -> DataFrame:
    """Shards with the codes and ids of their frequent words, by a join."""
    words = table.select("shard", F.posexplode("names").alias("code", "x")).select("shard", "code", "x.lang", "x.word")
    fields = ["code", "id"]
    names = words.join(one.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct(*fields)).alias("names"))
    return table.select("shard", "positions", "codes").join(names, "shard").select("shard", "positions", "codes", *(F.col("names")[c].alias(c) for c in fields))


def phrases(docs: DataFrame, longest: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, a) of all words and phrases of up to ``longest`` words that occur ``least`` times, (lang, n) words
    of each language). Both are tables of :func:`written`."""
    lang, text = F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    size, few = SHARD_BYTES, SHARDS_AT_ONCE
    table = written(docs.select(lang, text).mapInArrow(lambda batches: _shards(batches, size), _SHARDS), "shards", few, DOCS_AT_ONCE)
    words = table.select(F.inline("names"))
    total = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang-words")
    one = words.groupBy("lang", "word").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    one = written(one.select("*", F.monotonically_increasing_id().alias("id"), *_hashes(F.col("lang"), F.col("word"))), "frequent")
    one, bits = _numbered(one)
    known = _known(one)
    if known is None:
        shards = written(_joined(table, one), "shards", few)
        released(table)
    else:
        h = F.transform("names", lambda x: _hashes(x["lang"], x["word"])[0]).alias("h")
        check = F.transform("names", lambda x: _hashes(x["lang"], x["word"])[1]).alias("check")
        shards = table.select("shard", "positions", "codes", h, check)
    pairs = written(_frequent_pairs(shards, known, bits, least), "pairs", batch_rows=few)
    two = pairs.join(one.select(F.col("id").alias("first"), "lang", F.col("word").alias("w")), "first").join(one.select(F.col("id").alias("second"), "word"), "second")
    parts = [one.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "a"), two.select("lang", F.concat_ws(" ", "w", "word").alias("phrase"), F.lit(2).alias("size"), "a")]
    if longest > 2:
        n = pairs.count()
        if n <= FILTERED_PAIRS:
            found = _longer(shards, longest, known, bits, docs.sparkSession.sparkContext.broadcast(_filter(pairs, n)))
        else:
            good = _pairs(shards, known).join(pairs.select("first", "second"), ["first", "second"]).groupBy("shard").agg(F.collect_list(F.struct("first", "second")).alias("pairs"))
            found = _longer(shards.join(good, "shard"), longest, known, bits)
        parts.append(_frequent_longer(found, one, longest, bits, least))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = written(out, "phrases", batch_rows=few)
    released(table if known else shards, one, pairs)
    return out, total


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, first: int = 2000, percent: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``first`` best phrases of 2 to ``longest`` words of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase that occurs ``a`` times (``least`` or more) is cut in two, of ``l`` and ``r`` occurrences; the cut with the least
    floor(2000000 a / (l + r)) counts, of equal ones the first. Phrases within a longer candidate of ``percent`` or more in a
    hundred of their occurrences are left out. A null language is ``und``; a null or empty text has no words; repeated rows
    count as often as they occur; ties go by occurrences, then by the bytes of the phrase; empty tables give an empty
    result; other columns are ignored. Texts are used whole.
    """
    table, total = phrases(docs, longest, least, lang_col, text_col)
    words = F.split("phrase", " ", -1)
    long = table.filter("size > 1").withColumn("words", words)
    cut = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    part = lambda at, n: F.concat_ws(" ", F.slice("words", at, n))
    cut = cut.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(table.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("size").alias("size"))
    within = long.filter("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    held = within.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), F.col("a").alias("held")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    most = F.coalesce(exact("held"), F.lit(0).cast("decimal(19,0)"))
    kept = best.join(held, ["lang", "phrase"], "left").filter(~(most * 100 >= exact("a") * percent))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return top.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY 1), f AS (SELECT * FROM g WHERE a >= 30),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS v FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * k.a // (x.a + y.a) AS BIGINT) AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(v[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(v[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, array_to_string(v[i:i + z - 1], ' ') AS phrase, max(a) AS held FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM c)) GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN h ON b.lang = h.lang AND b.phrase = h.phrase WHERE NOT coalesce(100::HUGEINT * held >= 80::HUGEINT * a, false))
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000
"""
