"""Resampling of documents by importance weights for a target distribution of hashed n-grams.

Texts are cut into blocks of documents. A block keeps each of its distinct n-grams once, with a count, and its
documents as local numbers of n-grams. The distinct words of all blocks get integer ids; an n-gram is the tuple of
its words' ids; the distinct tuples of the corpus are counted by an aggregation, each tuple's bytes are put together
from the dictionary and hashed once, and buckets follow. The gain of a tuple's bucket is joined back to the blocks
that hold the tuple, which then weigh their documents.

So a word that every document holds is one row a block, not one a document, in every join; long documents are blocks of
their own, and what a document adds to a shuffle is a compressed number for each n-gram, once. The draw is the Gumbel top-k of weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .coding import LETTERS_AND_DIGITS, coded, row_blocks, text_bytes, word_spans
from .common import read_table, released, written

#: Bytes of text a block; it bounds memory and changes no result.
BLOCK_BYTES = 8 << 20
_GRAMS = "block long, docs array<long>, words_of array<long>, sizes array<long>, codes binary, gram int, words array<string>, n long"


def block_grams(text: pa.ChunkedArray, n: int) -> tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each distinct n-gram by length, its count, n-gram numbers by document, documents' words and n-grams)."""
    data, bounds = text_bytes(text)
    starts, ends = word_spans(data, bounds, LETTERS_AND_DIGITS)
    dictionary, code = coded(data, starts, ends, LETTERS_AND_DIGITS)
    cut = np.searchsorted(starts, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(cut))
    names, counts, numbers, rows = [], [], [], []
    gram, distinct, known = code, len(dictionary), 0
    for m in range(1, n + 1):
        at = np.arange(len(code) - m + 1)
        if m > 1:
            at = at[row[: len(at)] == row[m - 1 :]]
            keys = gram[at] * len(dictionary) + code[at + m - 1]
            _, first, gram_at = np.unique(keys, return_index=True, return_inverse=True)
            gram = np.full(len(code), -1, np.int64)
            gram[at], distinct = gram_at, len(first)
            first = at[first]
        else:
            first = np.full(distinct, -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
        each = np.stack([code[first + j] for j in range(m)], axis=1).ravel() if distinct else np.zeros(0, np.int64)
        names.append(pa.FixedSizeListArray.from_arrays(dictionary.take(pa.array(each)).cast(pa.string()), m))
        counts.append(np.bincount(gram[at], minlength=distinct))
        numbers.append(gram[at] + known)
        rows.append(row[at])
        known += distinct
    numbers, rows = np.concatenate(numbers), np.concatenate(rows)
    if n > 1:
        numbers = numbers[np.argsort(rows, kind="stable")]
    return names, np.concatenate(counts), numbers.astype(np.int32), np.diff(cut), np.bincount(rows, minlength=len(bounds) - 1)


def _blocks(docs: DataFrame, n: int, keep_documents: bool) -> DataFrame:
    """A row for each block with its documents, and one for each of its distinct n-grams. ``docs`` has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for table in row_blocks(batches, 1, BLOCK_BYTES):
            names, counts, numbers, words, sizes = block_grams(table.column(1), n)
            k, block = len(counts), block + 1
            listed = pa.chunked_array([x.cast(pa.list_(pa.string())) for x in names]).combine_chunks()
            none = lambda t: pa.nulls(k, t)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, block)), none(longs), none(longs), none(longs), none(pa.binary()), pa.array(np.arange(k, dtype=np.int32)), listed, pa.array(counts)],
                names=[c.split()[0] for c in _GRAMS.split(", ")],
            )
            if keep_documents:
                ids = table.column(0).combine_chunks().cast(pa.int64()).to_pylist()
                yield pa.RecordBatch.from_pylist(
                    [{"block": block, "docs": ids, "words_of": words.tolist(), "sizes": sizes.tolist(), "codes": pa.compress(numbers.tobytes(), "zstd", asbytes=True)}],
                    pa.schema([("block", pa.int64()), ("docs", longs), ("words_of", longs), ("sizes", longs), ("codes", pa.binary()), ("gram", pa.int32()), ("words", pa.list_(pa.string())), ("n", pa.int64())]),
                )

    return docs.mapInArrow(run, _GRAMS)


def _in_place(rows: DataFrame, keys: list[str], items: str, table: DataFrame, on: str, value: str, n: int) -> DataFrame:
    """``rows`` with its array ``items`` looked up in ``table``, place by place, as the array ``value``."""
    if n == 1:
        return rows.withColumn(on, F.col(items)[0]).join(table, on).select(*keys, F.array(value).alias(value))
    each = rows.select(*keys, F.posexplode(items).alias("_place", on)).join(table, on)
    listed = F.array_sort(F.collect_list(F.struct("_place", value)))
    return each.groupBy(*keys).agg(listed.alias("_all")).select(*keys, F.transform("_all", lambda x: x[value]).alias(value))


def _weighed(blocks: DataFrame, gains: DataFrame) -> DataFrame:
    """Each document's words, n-grams and weight, from its block's n-grams and their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, words_of, sizes, codes, gains = (batch.column(c)[i] for c in range(5))
                sizes = sizes.values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                gain = np.zeros(0, np.int64)
                if gains.is_valid:
                    gram, of = (gains.values.field(c).to_numpy(zero_copy_only=False) for c in ("gram", "gain"))
                    gain = np.zeros(len(gram), np.int64)
                    gain[gram] = of
                codes = np.frombuffer(pa.decompress(codes.as_py(), 4 * int(sizes.sum()), "zstd", asbytes=True), np.int32)
                total = np.concatenate([[0], np.cumsum(gain[codes])])
                weight = (total[ends] - total[ends - sizes]) // np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays([docs.values, words_of.values, pa.array(sizes), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    both = blocks.join(gains.groupBy("block").agg(F.collect_list(F.struct("gram", "gain")).alias("gains")), "block", "left")
    return both.select("docs", "words_of", "sizes", "codes", "gains").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def importance_weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's n-grams of 1 to ``n`` words.

    Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. Null and empty texts have no words
    and weight 0; repeated rows count and come out as often as they occur; null ids stay; an empty table gives an empty
    result, an empty target gains from smoothing alone; other columns are ignored. Texts are used whole.
    """
    source = written(_blocks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), n, True), "blocks")
    wanted = written(_blocks(target.select(F.lit(0).cast("long").alias("id"), F.col(target_text).cast("string").alias("text")), n, False), "target-blocks")
    one = F.lit(True)
    grams = source.filter("gram is not null").select("block", "gram", "words", "n", (~one).alias("target")).union(wanted.filter("gram is not null").select("block", "gram", "words", "n", one))
    dictionary = written(grams.select(F.explode("words").alias("word")).distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    tuples = written(_in_place(grams, ["block", "gram", "n", "target"], "words", dictionary, "word", "id", n).withColumnRenamed("id", "ids"), "tuples")
    count = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0).cast("long"))
    distinct = tuples.groupBy("ids").agg(count(~F.col("target")).alias("s"), count(F.col("target")).alias("t"))
    named = _in_place(distinct, ["ids", "s", "t"], "ids", dictionary, "id", "word", n)
    hashed = written(named.select("ids", "s", "t", (F.crc32(F.concat_ws(" ", "word")) % buckets).cast("int").alias("bucket")), "hashed")
    sums = hashed.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))  # at most `buckets` rows
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    gain = F.floor(1000 * F.ln((F.col("t") + 1) * F.lit(total[0] + buckets) / ((F.col("s") + 1) * F.lit(total[1] + buckets))))
    by_tuple = hashed.filter("s > 0").join(F.broadcast(sums.select("bucket", gain.alias("gain"))), "bucket").select("ids", "gain")
    gains = tuples.filter("not target").join(by_tuple, "ids").select("block", "gram", "gain")
    out = written(_weighed(source.filter("docs is not null").select("block", "docs", "words_of", "sizes", "codes"), gains), "weights")
    released(source, wanted, dictionary, tuples, hashed)
    return out


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3, ... in that order: a range sort, then the number of rows in the ranges before."""
    at = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    before = at.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition of the sort
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    placed = at.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return placed.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, n: int = 1, buckets: int = 10_000, **columns: str) -> DataFrame:
    """Every document with its weight, its score (weight plus Gumbel noise in thousandths) and, if drawn, its rank.

    Of the documents of at least ``min_words`` words ``percent`` in a hundred are drawn, without replacement, by highest
    score, ties by the least id. Noise comes from a hash of seed and id (of the seed alone for a null id), so equal ids
    have equal noise. Rows as in :func:`importance_weights`; documents that are not drawn have a null rank.
    """
    weighed = importance_weights(docs, target, n, buckets, **columns)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))
    scored = weighed.withColumn("score", F.col("weight") + noise)
    fit = F.col("n_words") >= min_words
    drawn = percent * scored.filter(fit).count() // 100
    first = ranked(scored.filter(fit), F.col("score").desc(), F.col("doc_id"))
    out = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("n_words")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(0, 256))::BIGINT AS i))),
d AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS_SQL.format('text')} AS w FROM documents),
dw AS (SELECT row, unnest(w) AS w FROM d), tw AS (SELECT unnest({_WORDS_SQL.format('text')}) AS w FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
bytes AS (SELECT w, list_transform(range(1, CAST(length(h) / 2 AS BIGINT) + 1), lambda i: ('0x' || substr(h, CAST(2 * i - 1 AS INTEGER), 2))::BIGINT) AS b FROM words),
hashed AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM tw JOIN hashed USING (w) GROUP BY 1),
tot AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM tw)::DOUBLE AS t_all),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), tot),
wt AS (SELECT row, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
sc AS (SELECT doc_id, row, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN wt USING (row)),
rk AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM sc LEFT JOIN rk USING (row)
"""
