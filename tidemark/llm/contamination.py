"""Benchmark decontamination in DataFrame operations only: test n-grams as a broadcast hash set, verified hits, spans.

The windows of all test items are normalised, made distinct and numbered. Their 64-bit hashes alone are broadcast, in
rounds of a bounded number; each window of the training texts is hashed where it is read and looked up there, so
nothing but hits ever leaves a task. Hits are verified by their words, windows of a document are joined into spans, and
windows lead to the items that have them. A passage that many documents or items hold is looked up by number, once
for each document; no hit is paired with all items' texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes broadcast at once (some 50 MB); more windows take more rounds over the documents.
ROUND = 1_000_000
#: Bytes of test windows up to which hits are verified by a broadcast join; beyond it by a shuffled one.
BROADCAST_BYTES = 32 << 20


def ascii_lower(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII; of a null text none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _gram(m: Column) -> Column:
    return F.slice("words", F.col("pos") + 1, m)


def _known(items: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(distinct windows: wid, h, m, gram), (wid, item_id)."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("words")).filter("size(words) > 0")
    m = F.least(F.lit(n), F.size("words"))
    each = w.withColumn("m", m).withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("m"))))
    each = each.select("item_id", "m", F.xxhash64(_gram(F.col("m"))).alias("h"), F.concat_ws(" ", _gram(F.col("m"))).alias("gram"))
    known = written(each.select("gram", "m", "h").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    named = each.filter("item_id is not null").select("item_id", "gram").distinct().join(known.select("gram", "wid"), "gram").select("wid", "item_id")
    return known, written(named, "window-items")


def _key(id_col: str, text_col: str) -> Column:
    """Equal for rows of equal id and text, which have equal results."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))))


def hits(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, pos, m, wid): each place of a document, counted in words, where a known window of ``m`` words occurs."""
    spark = docs.sparkSession
    sizes = known.groupBy("m").agg(F.count_distinct("h").alias("n"), F.sum(F.octet_length("gram")).alias("bytes")).collect()  # a row for each length up to n
    text = docs.select(_key(id_col, text_col).alias("key"), words(F.col(text_col)).alias("words"))
    out = spark.createDataFrame([], "key string, pos int, m int, h long, gram string")
    for r in sorted(sizes, key=lambda r: r["m"]):
        m, rounds = r["m"], -(-r["n"] // ROUND)
        places = text.filter(F.size("words") >= m).withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("words") - m)))
        places = places.withColumn("h", F.xxhash64(_gram(F.lit(m))))
        for i in range(rounds):
            part = known.filter((F.col("m") == m) & (F.pmod("h", F.lit(rounds)) == i)).select("h").distinct()
            found = places.join(F.broadcast(part), "h")
            out = out.union(found.select("key", "pos", F.lit(m).alias("m"), "h", F.concat_ws(" ", _gram(F.lit(m))).alias("gram")))
    small = sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    true = known.select("gram", "wid")
    return out.distinct().join(F.broadcast(true) if small else true, "gram").select("key", "pos", "m", "wid")


def spans(found: DataFrame) -> DataFrame:
    """(key, spans, n_hit): the maximal runs of hit words of each document, as word numbers from and up to."""
    w = Window.partitionBy("key").orderBy("pos", "m")
    before = F.max(F.col("pos") + F.col("m")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    each = found.select("key", "pos", "m").distinct().withColumn("new", F.coalesce((F.col("pos") > before).cast("int"), F.lit(1)))
    runs = each.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "run").agg(F.min("pos").alias("a"), F.max(F.col("pos") + F.col("m")).alias("b"))
    return runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"), F.sum(F.col("b") - F.col("a")).cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each document's words that occur in windows of test items: (key, doc_id, n_words, spans, n_hit, items, n_items).

    A window is ``n`` consecutive words of an item; an item of fewer words is one window, an item without words none.
    Null texts have no words; null ids stay; repeated rows have equal results; items under one id are one item, and an
    item without an id counts for words but is not named; an empty table of documents gives an empty result, one of
    items no hits; other columns are ignored. Texts are used whole. ``key`` is equal for rows of equal id and text.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known, named = _known(items, n, item_id, item_text)
    found = written(hits(docs, known), "hits")
    by_item = found.select("key", "wid").distinct().join(named, "wid").select("key", "item_id").distinct()
    listed = by_item.groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    of = spans(found).join(listed, "key", "left")
    base = docs.select(_key("doc_id", "text").alias("key"), "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(of, "key", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("key", "doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), items_.alias("items"), F.size(items_).cast("long").alias("n_items"))


#: What stands before a word, and the word, in a text as it is written.
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def decontaminated(docs: DataFrame, items: DataFrame, n: int = 10, whole_documents: bool = False, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the words that windows of test items hit (each with what stands before it), or without the
    documents that have any. Columns stay as they are, whatever their names; a text that is hit as a whole gets empty.
    """
    dirty = contamination(docs, items, n, id_col, text_col, item_id, item_text).filter("n_hit > 0").select("key", "spans").dropDuplicates(["key"])
    keyed = docs.select(_key(id_col, text_col).alias("key"), F.struct(*(F.col(c) for c in docs.columns)).alias("doc"))
    if whole_documents:
        return keyed.join(dirty, "key", "left_anti").select("doc.*")
    text = F.col("doc")[text_col]
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists("spans", lambda s: (s["a"] <= i) & (i < s["b"])))
    rest = F.expr(f"substring(doc.`{text_col}`, char_length(array_join(pieces, '')) + 1)")
    out = keyed.join(dirty, "key", "left").withColumn("pieces", pieces)
    cut = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), rest))
    return out.select(*(cut.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS_SQL.format('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS_SQL.format('text')} AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS m, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM bw), sizes AS (SELECT DISTINCT m FROM known),
dw AS (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m),
hit AS (SELECT row, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM dw),
found AS (SELECT row, i, m, g FROM hit WHERE g IN (SELECT g FROM known)),
hw AS (SELECT row, count(DISTINCT i + j) AS n_hit FROM (SELECT row, i, unnest(range(0, m)) AS j FROM found) GROUP BY 1),
it AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM found JOIN known USING (g) WHERE item_id IS NOT NULL GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (row) LEFT JOIN it USING (row)
"""
