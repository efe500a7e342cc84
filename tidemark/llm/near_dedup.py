"""Near-duplicate classes by fast similarity sketches, banding and verification on full shingle sets.

Sketch (Dahlgaard, Knudsen, Thorup, "Fast similarity sketching", 2017): in round i every shingle of a set throws
one value into one of t bins, and a bin keeps the least of (round, value). Rounds t to 2t-1 aim all shingles at one
bin each, so every bin fills; a set stops after the round that fills its last bin, in expected time n + t log t.
Two sets agree in a bin with probability equal to their Jaccard similarity, with the concentration of
independent samples. With t = 128 in 32 bands of 4, a pair at similarity 0.85 shares a band with probability
1 - 6e-11.

Equal sets are one class from the start. Pairs are never listed within a bucket of a band: every member is checked
against one hub of its bucket, the member that shares most buckets; then, in buckets that still hold several
components, against another hub. What is left are members of such mixed buckets. Linked sets share one of their rarest few shingles,
so the shingles by which they meet from here on are the first of each set in order of rarity, where these too lead to
several components. Groups of sets that meet are dealt into blocks of a bounded number of sets and shingles; each two
blocks of a group meet in one row, whose task counts the common shingles of all their sets at once and returns only links
that join components. A component is what verified links connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, released, written
from .components import components
from .hashing import mixed, text_blocks, word_hashes

WORDS, BINS, BANDS = 5, 128, 32
_PLACE = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each row's distinct shingles, ascending: 64-bit hashes of WORDS words, or of all if fewer."""
    h, row, _, _ = word_hashes(data, bounds)
    n_rows = len(bounds) - 1
    words = np.bincount(row, minlength=n_rows)
    first = np.r_[0, np.cumsum(words)]
    sums = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        sums += h[j : len(h) - WORDS + 1 + j] * _PLACE[j]
    whole = np.flatnonzero(row[: len(sums)] == row[WORDS - 1 :]) if len(sums) else np.zeros(0, int)
    short = np.flatnonzero((words > 0) & (words < WORDS))
    values = [mixed(sums[whole])]
    rows = [row[whole]]
    if len(short):
        values.append(np.array([int(mixed(np.array([(h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]))[0]) for a, b in zip(first[short], first[short + 1])], np.uint64))
        rows.append(short)
    values, rows = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.r_[0, np.cumsum(np.bincount(rows, minlength=n_rows))]


def sketches(values: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(rows, bins) fast similarity sketches of the sets; rows with an empty set keep the greatest value."""
    n_rows = len(bounds) - 1
    empty = np.iinfo(np.uint64).max
    out = np.full(n_rows * bins, empty, np.uint64)
    row = np.repeat(np.arange(n_rows), np.diff(bounds))
    for i in range(2 * bins):
        if not len(values):
            break
        v = mixed(values + mixed(np.full(1, i + 1, np.uint64)))
        at = (v % np.uint64(bins)).astype(np.int64) if i < bins else np.full(len(v), i - bins)
        np.minimum.at(out, row * bins + at, np.uint64(i) << np.uint64(52) | v >> np.uint64(12))
        open_rows = (out.reshape(n_rows, bins) == empty).any(1)
        keep = open_rows[row]
        if not keep.all():
            values, row = values[keep], row[keep]
    return out.reshape(n_rows, bins)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sketch.shape[1] // bands
    out = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketch), bands)).copy()
    for j in range(rows):
        out = mixed(out + sketch[:, j::rows][:, :bands] * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the keys of its bands (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, data, bounds in text_blocks(batch.column(1)):
                values, of = shingle_sets(data, bounds)
                n = np.diff(of)
                sums = [np.r_[np.uint64(0), np.cumsum(mixed(values + np.uint64(s)), dtype=np.uint64)] for s in (77, 99)]
                digest = [(x[of[1:]] - x[of[:-1]]).view(np.int64) for x in sums]
                keys = band_keys(sketches(values, of))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(n)), pa.array(n.astype(np.int64)), *map(pa.array, digest), lists], names=["doc_id", "n_shingles", "d1", "d2", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in text_blocks(batch.column(1)):
                values, of = shingle_sets(data, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(of) - 1), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(values.view(np.int64)))], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


#: Shingles and sets of a block, about; a larger set is a block of its own. Two blocks take some 100 MB to compare.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 16, 1 << 11


def rarest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component, n, least): of members (id, component) those that meet a set of another component by a shingle that
    is among the rarest n - ceil(percent n / 100) + 1 of both, and the least id that they meet by it.

    Any order of shingles that is the same for all sets leaves no link out; the rarest first makes the fewest meet.
    """
    each = members.join(sets, "id").select("id", "component", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("of"), F.explode("shingles").alias("key"))
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("sets"))
    place = F.row_number().over(Window.partitionBy("id", "of").orderBy("sets", "key"))
    first = each.join(counts, "key").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)
    first = written(first.filter("sets > 1").select("id", "component", "n", "key"), "rarest")
    mixed_up = first.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("id").alias("least")).filter("c1 <> c2").select("key", "least")
    out = written(first.join(mixed_up, "key").select("id", "component", "n", "least"), "mixed-buckets")
    released(first)
    return out


def _block_links(ids: tuple, comps: tuple, sets: tuple, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks (or within one, ``same``) that join components which these links had not joined yet."""
    bounds = [np.r_[0, np.cumsum([len(s) for s in side])] for side in sets]
    sizes = [np.diff(b) for b in bounds]
    values = [np.concatenate([np.asarray(s, np.int64) for s in side]) for side in sets]
    could = (100 * np.minimum(sizes[0][:, None], sizes[1]) >= percent * np.maximum(sizes[0][:, None], sizes[1])) & (comps[0][:, None] != comps[1])
    if same:
        could = np.triu(could, 1)
    if not could.any():
        return []
    shared = np.intersect1d(values[0], values[1])
    common = np.zeros(could.shape, np.float32)
    at = [np.searchsorted(shared, v) for v in values]
    hit = [(a < len(shared)) & (shared[np.minimum(a, len(shared) - 1)] == v) if len(shared) else np.zeros(len(v), bool) for a, v in zip(at, values)]
    owner = [np.repeat(np.arange(len(z)), z)[h] for z, h in zip(sizes, hit)]
    at = [a[h] for a, h in zip(at, hit)]
    for lo in range(0, len(shared), 4096):
        sides = []
        for a, o, z in zip(at, owner, sizes):
            mine = (a >= lo) & (a < lo + 4096)
            m = np.zeros((len(z), min(4096, len(shared) - lo)), np.float32)
            m[o[mine], a[mine] - lo] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    linked = could & (100 * common >= percent * (sizes[0][:, None] + sizes[1] - common))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = root(int(comps[0][i])), root(int(comps[1][j]))
        if a != b:
            parent[a] = b
            out.append((int(ids[0][i]), int(ids[1][j])))
    return out


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A table of links (a, b) between members (id, group, component, n) of one group and different components, on their full sets."""
    counts = members.groupBy("group").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"), F.count_distinct("component").alias("c")).filter("c > 1").drop("c")
    dealt = members.join(counts, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = dealt.join(sets, "id").groupBy("group", "blocks", "block").agg(F.collect_list(F.struct("id", "component", "shingles")).alias("held"))
    packed = written(packed, "set-blocks")
    first = packed.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    other = packed.select("group", F.col("block").alias("other"), F.col("held").alias("held2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                sides = [batch.column(c)[i].values for c in (2, 3)]
                ids, comps = ([s.field(n).to_numpy() for s in sides] for n in ("id", "component"))
                held = [[x.values.to_numpy() for x in s.field("shingles")] for s in sides]
                rows += _block_links(tuple(ids), tuple(comps), tuple(held), batch.column(0)[i].as_py() == batch.column(1)[i].as_py(), percent)
            yield pa.RecordBatch.from_arrays([pa.array([min(r) for r in rows], pa.int64()), pa.array([max(r) for r in rows], pa.int64())], names=["a", "b"])

    found = written(first.join(other, ["group", "other"]).select("block", "other", "held", "held2").mapInArrow(run, "a long, b long"), "near-links")
    released(packed)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 x |A and B| >= ``percent`` x |A or B| on their sets of shingles of five words (all
    words if fewer), with A-Z in lower case. Documents without words (or with null text) are linked with nothing.
    component_id is the least id that links lead to. Rows that repeat an id are
    one node with the links of each and give a row each; rows with a null id are linked with nothing (component_id
    null, kept true). Other columns are
    ignored; an empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = written(signatures(named, "doc_id", "text"), "sketches")
    # A class is a set; rep is the least id that has it. Copies are thousands of rows of one class: partial minima first.
    classes = written(sig.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")), "classes")
    keyed = classes.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = written(keyed.join(shared, "key"), "buckets")
    degree = buckets.groupBy("id").agg(F.sum("size").alias("degree"))
    candidates = named.withColumnRenamed("doc_id", "id").join(degree, "id", "left_semi")
    sets = written(full_sets(candidates.select("id", "text")), "shingles")
    members = written(buckets.join(degree, "id"), "members")
    released(buckets)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that the full sets link. Sizes decide first what cannot be linked."""
        both = pairs.join(sets.withColumnRenamed("id", "a").withColumnRenamed("shingles", "sa"), "a").join(sets.withColumnRenamed("id", "b").withColumnRenamed("shingles", "sb"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    could = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
    pair = (F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
    tested = comps = None

    def joined(found: DataFrame, comps: DataFrame | None) -> DataFrame:
        """Components of new links and of those known so far, which are stars already. Both tables are used up."""
        if comps is None:
            out = components(found)
        elif found.isEmpty():
            out = comps
        else:
            out = components(found.union(comps.select("id", "component").filter("id <> component")))
            released(comps)
        released(found)
        return out

    for turn in range(2):
        current = members.withColumn("component", F.col("id")) if comps is None else members.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
        order = F.struct("degree", -F.col("id")) if turn == 0 else F.struct(F.xxhash64("id", "component"), "id")
        hubs = current.groupBy("key").agg(F.max_by(F.struct(F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("component").alias("component2")), order).alias("hub"), F.min("component").alias("c1"), F.max("component").alias("c2"))
        hubs = hubs.filter("c1 <> c2").select("key", "hub.*")
        pairs = current.join(hubs, "key").filter("component <> component2").filter(could).select(*pair).groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        found = written(verified(pairs), "near-links")
        if tested is not None:
            released(tested)
        tested = pairs
        comps = joined(found, comps)
    current = members.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed_up = current.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("key")
    open_ = written(current.join(mixed_up, "key").groupBy("id").agg(F.first("component").alias("component")), "open")
    left = rarest(open_, sets, percent)
    released(open_)
    if not left.isEmpty():
        groups = components(left.select(F.col("id").alias("a"), F.col("least").alias("b")))
        found = block_links(left.groupBy("id").agg(F.first("component").alias("component"), F.first("n").alias("n")).join(groups.withColumnRenamed("component", "group"), "id"), sets, percent)
        released(groups)
        comps = joined(found, comps)
    released(tested, left, members, sets)
    rep = classes.select("n_shingles", "d1", "d2", "rep")
    of_rep = rep.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = sig.drop("keys").join(of_rep, ["n_shingles", "d1", "d2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
