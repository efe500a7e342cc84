"""Language identification of mixed-language text: script ranges, per-word scores, and a Viterbi pass with a switching penalty.

A word is a run of letters. Its score for a language is the sum, over its letters, of log likelihoods of the byte
n-grams around each letter and of the whole word, from hashed tables of a fixed size that hold counts over all
training texts. A word's script leaves only the languages that training texts write in that script. The Viterbi
pass over the words of a text finds the labelling of greatest total score in which each change of language
between two words costs a penalty; runs of one label are the spans. A text's language is that of most letters.

The pass is exact for texts of any length and runs on segments of a fixed number of words in step: first the
(max, +) transfer of every segment, then a scan over the segments of each text, then the paths within segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, written
from .hashing import mixed, text_blocks

TABLE_BITS, TABLES, CHUNKS = 15, 4, 16
SWITCH, WEIGHT, SEGMENT = 12.0, 0.4, 32
#: First byte of a UTF-8 sequence -> script. Ranges of lead bytes: Latin, Greek, Cyrillic, Armenian/Hebrew, Arabic and Syriac, Indic and South-East Asian, other, kana, Han, Hangul, beyond the basic plane.
_LEADS = [(0xC2, 0), (0xCD, 1), (0xD0, 2), (0xD5, 3), (0xD8, 4), (0xE0, 5), (0xE2, 6), (0xE3, 7), (0xE4, 8), (0xEA, 9), (0xEE, 6), (0xF0, 10)]
SCRIPTS = 11
_SCRIPT = np.zeros(256, np.int64)
for _lead, _script in _LEADS:
    _SCRIPT[_lead:] = _script
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SPACE = np.uint8(32)
#: Languages whose tables (half a megabyte each) may go to all tasks, and bytes of transfers that are worked on at once.
MOST_LANGUAGES, TRANSFER_BYTES = 400, 32 << 20


def _symbols(data: np.ndarray) -> np.ndarray:
    """Places of the bytes of characters beyond ASCII that are no letters, by their blocks: Latin-1 signs but for ª, µ
    and º, the multiplication and division signs, general punctuation to miscellaneous arrows but for letter-like
    signs, supplemental and CJK punctuation but for the iteration mark, and pictographs."""
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead + 1 < len(data)]
    a, b = data[lead], data[lead + 1]
    c = data[np.minimum(lead + 2, len(data) - 1)]
    two = (a == 0xC2) & ~np.isin(b, (0xAA, 0xB5, 0xBA)) | (a == 0xC3) & np.isin(b, (0x97, 0xB7))
    three = (a == 0xE2) & ((b < 0xB0) & (b != 0x84) | (b == 0xB8) | (b == 0xB9)) | (a == 0xE3) & (b == 0x80) & (c != 0x85)
    four = (a == 0xF0) & (b == 0x9F)
    return np.concatenate([lead[which] + i for which, n in ((two, 2), (three, 3), (four, 4)) for i in range(n)])


def words_and_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, script) of each word, and (letters, TABLES - 1) n-gram slots followed by the words' own slots.

    The last array is a pair: slots of letters, and slots of words.
    """
    n = len(data)
    x = _FOLD[data]
    x[_symbols(data)] = _SPACE
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    letter = np.flatnonzero(x != _SPACE)
    wide = np.full(n + 3, _SPACE)
    wide[1 : n + 1] = x
    here = x[letter]
    before = np.where(edge[letter], _SPACE, wide[letter])
    one = np.where(edge[letter + 1], _SPACE, wide[letter + 2])
    two = np.where((one == _SPACE) | edge[np.minimum(letter + 2, n)], _SPACE, wide[np.minimum(letter + 3, n + 2)])
    starts = np.flatnonzero(before == _SPACE)
    ends = np.flatnonzero(one == _SPACE)
    b, h, o, t = (v.astype(np.uint64) for v in (before, here, one, two))
    bi, tri, four = b | h << np.uint64(8), b | h << np.uint64(8) | o << np.uint64(16), b | h << np.uint64(8) | o << np.uint64(16) | t << np.uint64(24)
    shift = np.uint64(64 - TABLE_BITS)
    slots = np.stack([(mixed(v + np.uint64(1 + i << 40)) >> shift).astype(np.int64) + (i << TABLE_BITS) for i, v in enumerate((bi, tri, four))], 1) if len(letter) else np.zeros((0, 3), np.int64)
    code = mixed(tri + np.uint64(7 << 40))
    sums = np.r_[np.uint64(0), np.cumsum(code, dtype=np.uint64)]
    word_slots = (mixed(sums[ends + 1] - sums[starts]) >> shift).astype(np.int64) + (3 << TABLE_BITS)
    script = np.maximum.reduceat(_SCRIPT[here], starts) if len(starts) else np.zeros(0, np.int64)
    row = np.searchsorted(bounds, letter[starts], "right") - 1
    return row, letter[starts], letter[ends] + 1, script, (slots, word_slots, starts)


def fit(docs: DataFrame, text_col: str, lang_col: str) -> dict:
    """Counts over all rows of ``docs`` with a language. The tables have a fixed size; tasks add up what they read."""
    size = TABLES << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for at, data, bounds in text_blocks(batch.column(0)):
                row, start, end, script, (slots, word_slots, first) = words_and_features(data, bounds)
                if not len(row):
                    continue
                mine = langs[at : at + len(bounds) - 1][row]
                for lang in set(mine.tolist()):
                    words = mine == lang
                    of_letter = np.repeat(words, np.diff(np.r_[first, len(slots)]))
                    total = sums.setdefault(lang, np.zeros(size + SCRIPTS, np.int64))
                    total[:size] += np.bincount(slots[of_letter].ravel(), minlength=size) + np.bincount(word_slots[words], minlength=size)
                    total[size:] += np.bincount(script[words], minlength=SCRIPTS)
        yield from _rows({(k, c): x for k, v in sums.items() for c, x in enumerate(np.array_split(v, CHUNKS))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for lang, chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(data, "<i8")
                sums[lang, chunk] = sums[lang, chunk] + x if (lang, chunk) in sums else x
        yield from _rows(sums)

    schema = "lang string, chunk int, counts binary"
    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = known.mapInArrow(count, schema).repartition(CHUNKS, "lang", "chunk").mapInArrow(add, schema).collect()
    parts = {(r["lang"], r["chunk"]): np.frombuffer(r["counts"], "<i8") for r in rows}
    langs = sorted({k for k, _ in parts})
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages: their tables are too large to go to every task")
    counts = np.array([np.concatenate([parts[lang, c] for c in range(CHUNKS)]) for lang in langs], np.float64).reshape(len(langs), size + SCRIPTS)
    tables = counts[:, :size].reshape(len(langs), TABLES, 1 << TABLE_BITS) + 0.5
    scores = np.log(tables / tables.sum(2, keepdims=True)).reshape(len(langs), size)
    scores -= scores.max(0, initial=-np.inf)
    scripts = counts[:, size:]
    # A language may be written in a script that has at least a thousandth of its words, or most of the script's.
    allowed = (scripts >= 0.001 * scripts.sum(1, keepdims=True)) & (scripts > 0) | (scripts > 0.5 * scripts.sum(0, keepdims=True))
    return {"langs": langs, "scores": np.ascontiguousarray(np.maximum(scores, -6).T, np.float32), "allowed": allowed}


def _rows(sums: dict) -> Iterator[pa.RecordBatch]:
    for (lang, chunk), x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([chunk], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["lang", "chunk", "counts"])


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of greatest total score; ``first``: bounds of the texts' words. Texts without words have none."""
    n, k = scores.shape
    words = np.diff(first)
    segs = -(-words // SEGMENT)
    n_segs = int(segs.sum())
    if not n_segs:
        return np.zeros(0, np.int64)
    seg_first = np.r_[0, np.cumsum(segs)]
    doc = np.repeat(np.arange(len(words)), segs)
    begin = first[doc] + (np.arange(n_segs) - seg_first[doc]) * SEGMENT
    at = begin[:, None] + np.arange(SEGMENT)
    real = at < first[doc + 1][:, None]
    p = np.where(real[:, :, None], scores[np.minimum(at, n - 1)], 0).astype(np.float64)
    order = np.argsort(-segs, kind="stable")
    order = order[segs[order] > 0]
    counts = np.searchsorted(-segs[order], -np.arange(int(segs.max())), "left")  # texts with more than j segments
    level = np.repeat(np.arange(len(counts)), counts)
    slot = np.arange(n_segs) - np.repeat(np.cumsum(counts) - counts, counts)
    ids = seg_first[order[slot]] + level  # the first segment of every text, then the second of those that have one, ...
    entry = np.zeros((n_segs, k))
    now = np.zeros((len(order), k))
    size = max(1, TRANSFER_BYTES // (8 * k * k))
    for a in range(0, n_segs, size):
        mine = ids[a : a + size]
        d = np.where(np.eye(k, dtype=bool), 0.0, -1e300)[None].repeat(len(mine), 0)
        for t in range(SEGMENT):
            d = np.maximum(d, d.max(2, keepdims=True) - switch) + p[mine, t, None, :]
        edges = [0, *(np.flatnonzero(np.diff(level[a : a + size])) + 1).tolist(), len(mine)]
        for x, y in zip(edges, edges[1:]):
            where = slot[a + x : a + y]
            entry[mine[x:y]] = now[where]
            nxt = (now[where][:, :, None] + d[x:y]).max(1)
            now[where] = nxt - nxt.max(1, keepdims=True)
    back = np.empty((SEGMENT, n_segs, k), np.int16)
    e = entry.copy()
    states = np.arange(k)
    for t in range(SEGMENT):
        best, top = e.argmax(1)[:, None], e.max(1, keepdims=True)
        stay = e >= top - switch
        back[t] = np.where(stay, states, best)
        e = np.where(stay, e, top - switch) + p[:, t]
    source = np.broadcast_to(states, (n_segs, k)).astype(np.int16)
    for t in range(SEGMENT - 1, -1, -1):
        source = np.take_along_axis(back[t], source.astype(np.int64), 1)
    last = np.zeros(n_segs, np.int64)
    state = now.argmax(1)
    for j in range(int(segs.max())):  # from the last segment of each text backwards
        m = counts[j]
        mine = seg_first[order[:m]] + segs[order[:m]] - 1 - j
        last[mine] = state[:m]
        state[:m] = source[mine, state[:m]]
    labels = np.empty((n_segs, SEGMENT), np.int64)
    rows, cur = np.arange(n_segs), last
    for t in range(SEGMENT - 1, -1, -1):
        labels[:, t] = cur
        cur = back[t][rows, cur].astype(np.int64)
    return labels[real]


def label_block(data: np.ndarray, bounds: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """(language index or -1, score, spans) of each text of a block."""
    row, start, end, script, (slots, word_slots, first) = words_and_features(data, bounds)
    n_rows, langs = len(bounds) - 1, model["langs"]
    if not len(row) or not langs:
        return np.full(n_rows, -1), np.zeros(n_rows), [[] for _ in range(n_rows)]
    table = model["scores"]
    per_letter = table[slots[:, 0]] + table[slots[:, 1]] + table[slots[:, 2]]
    s = WEIGHT * (np.add.reduceat(per_letter, first, axis=0) + 2 * table[word_slots])
    fits = model["allowed"].T[script]
    s = np.where(fits | ~fits.any(1, keepdims=True), s - s.max(1, keepdims=True), -60.0)
    s[~fits.any(1)] = 0
    bounds_of_words = np.searchsorted(row, np.arange(n_rows + 1))
    label = viterbi(s, bounds_of_words)
    letters = np.zeros((n_rows, len(langs)))
    begun = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # a character counts once, however many bytes it has
    np.add.at(letters, (row, label), begun[end] - begun[start])
    total = letters.sum(1)
    best = np.where(total > 0, letters.argmax(1), -1)
    score = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
    at = np.flatnonzero(new)
    to = np.r_[at[1:], len(row)] - 1
    spans: list[list[dict]] = [[] for _ in range(n_rows)]
    for r, a, b, k in zip(row[at].tolist(), start[at], end[to], label[at].tolist()):
        spans[r].append({"start": int(a - bounds[r]), "end": int(b - bounds[r]), "lang": langs[k]})
    return best, score, spans


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with lang_pred, lang_score and lang_spans (byte ranges) added.

    Null text, and text without letters, is ``und`` with score 0 and no spans. Each row is judged from its text
    alone; repeated rows, nulls and names in other columns do not matter (columns of the added names are
    replaced); an empty table gives an empty result; without any training text everything is ``und``.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "lang_score", "lang_spans")
    at_text = docs.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)  # languages x a fixed number of slots
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, data, bounds in text_blocks(batch.column(at_text)):
                best, score, spans = label_block(data, bounds, model)
                n = len(best)
                part = batch.slice(at, n)
                ascii_letters = np.add.reduceat(np.r_[(data | 32) - 97 < 26, False].astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0) if n else []
                for i in np.flatnonzero((best >= 0) & (np.asarray(ascii_letters) == 0)).tolist():  # only beyond ASCII: letters, or symbols?
                    if not any(map(str.isalpha, part.column(at_text)[i].as_py())):
                        best[i], score[i], spans[i] = -1, 0.0, []
                names = [model["langs"][i] if i >= 0 else "und" for i in best.tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score), pa.array(spans, span)], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_spans"])

    added = T.StructType.fromDDL("lang_pred string, lang_score double, lang_spans array<struct<start:bigint,end:bigint,lang:string>>")
    return docs.mapInArrow(run, T.StructType([*docs.schema, *added]))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_corpus(docs: DataFrame) -> dict:
    """The model of ``documents`` rows that are not held out. A null doc_id is not held out."""
    return fit(docs.filter(~held_out(F.col("doc_id"))), "text", "lang")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tagged = identify(docs.select("doc_id", "text"), fit_on_corpus(docs))
    return tagged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))
