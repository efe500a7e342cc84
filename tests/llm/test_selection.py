"""Resampling, collocations and decontamination against brute force, on small tables with every awkward row."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, common, contamination, resampling

from .test_operators import ROWS, docs, none, sentence  # noqa: F401

ITEMS = [("q10", sentence(3)), ("q9", sentence(1, 120)[:300]), ("q9", sentence(21)), ("q1", None), ("q2", ""), ("q3", "!!"), ("q4", "a b"), ("q5", "Wörter über"), (None, sentence(3)), ("q10", sentence(3))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, text string").withColumns({c: F.lit("clash") for c in ("n", "gram", "block", "words", "key", "h", "wid")})


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams(text, n):
    w = words(text)
    return [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def resample_brute(rows, target, n, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, n)) for texts in ([x for _, x in rows], target))
    a, b = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in s}
    out = []
    for i, x in rows:
        g = [gain[bucket(y)] for y in grams(x, n)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r) for r in out), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling(docs, none, items, n, monkeypatch):  # noqa: F811
    got = resampling.importance_resample(docs, items, 50, n=n, id_col="doc_id", text_col="text")
    want = resample_brute(ROWS, [x for _, x in ITEMS], n, percent=50)
    flat = lambda rows: sorted((r[:4] + r[5:] for r in rows), key=repr)
    rows = [tuple(r) for r in got.collect()]
    assert flat(rows) == flat(want) and len(rows) == len(ROWS)
    assert sorted((r[4], r[3]) for r in rows if r[4]) == sorted((r[4], r[3]) for r in want if r[4])
    assert resampling.importance_resample(none, items, n=n).count() == 0
    assert {r["weight"] for r in resampling.importance_weights(docs, items.filter("false"), n).collect()} != {0}


def test_blocks_change_nothing(spark):
    import pyarrow as pa

    from tidemark.llm.coding import row_blocks

    texts = ["a b", None, "", "c" * 50, "d e f", "ü"] * 7
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 6)), pa.array(texts[k : k + 6])], names=["i", "t"]) for k in range(0, 42, 6)]
    for size in (1, 5, 60, 10_000):
        parts = list(row_blocks(iter(batches), 1, size))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts and all(p.num_rows for p in parts)
        assert all(sum(len((x or "").encode()) + 1 for x in p.column(1).to_pylist()[:-1]) < size for p in parts)


def test_ranks_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 13).alias("x"), "id").repartition(7)
    got = resampling.ranked(rows, F.col("x").desc(), F.col("id")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [(r["x"], r["id"]) for r in got] == sorted(((i * 7 % 13, i) for i in range(1000)), key=lambda p: (-p[0], p[1]))


def contamination_brute(rows, items, n=10):
    known = defaultdict(set)
    for i, x in items:
        if w := words(x):
            m = min(n, len(w))
            for k in range(len(w) - m + 1):
                known[tuple(w[k : k + m])].add(i)
    out = []
    for i, x in rows:
        w, hit, named = words(x), set(), set()
        for m in {len(g) for g in known}:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in known:
                    hit |= set(range(k, k + m))
                    named |= known[g] - {None}
        out.append((i, len(w), len(hit), sorted(named)))
    return sorted(out, key=repr)


LEAKS = [*ROWS, (20, "before. " + sentence(1, 120)[:200].rsplit(" ", 1)[0] + " after that " + sentence(3).upper() + "!  end "), (20, "before. " + sentence(1, 120)[:200].rsplit(" ", 1)[0] + " after that " + sentence(3).upper() + "!  end "), (21, "x A-b y A"), (None, sentence(3)), (22, "WöRTER über Wörter ÜBER")]


@pytest.mark.parametrize("rounds", [1_000_000, 7])
def test_contamination(spark, items, none, rounds, monkeypatch):  # noqa: F811
    monkeypatch.setattr(contamination, "ROUND", rounds)
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", 32 << 20 if rounds > 7 else 0)
    table = spark.createDataFrame(LEAKS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "spans", "words", "pos", "h", "m", "doc", "pieces")})
    got = contamination.contamination(table, items)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=repr) == contamination_brute(LEAKS, ITEMS)
    assert contamination.contamination(none, items).count() == 0
    assert got.filter("n_hit > 0").count() > 5
    assert {(r["n_hit"], r["n_items"]) for r in contamination.contamination(table, items.filter("false")).collect()} == {(0, 0)}


@pytest.mark.parametrize("whole", [False, True])
def test_decontaminated(spark, items, whole):
    table = spark.createDataFrame(LEAKS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "spans", "words", "doc", "pieces")})
    out = contamination.decontaminated(table, items, whole_documents=whole)
    assert out.columns == table.columns and {r["key"] for r in out.collect()} == {"clash"}
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    found = {i: n for i, _, n, _ in contamination_brute(LEAKS, ITEMS)}
    if whole:
        assert [r for r in got if r[0] is not None] == sorted(((i, x) for i, x in LEAKS if i is not None and not found[i]), key=repr)
        return
    assert len(got) == len(LEAKS) and all((i, x) in got for i, x in LEAKS if i is not None and not found[i])
    texts = dict(got)
    assert texts[20] == "before after that!  end " and texts[21] == "x y A" and texts[22] == " Wörter ÜBER"  # beyond ASCII case counts
    assert all(n == 0 or len(words(texts[i])) == len(words(dict(LEAKS)[i])) - n for i, n in found.items() if i is not None)


def collocations_brute(rows, longest, least, first=2000, percent=80):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, x in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in x or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    held[p[k : k + m]] = max(held[p[k : k + m]], a)
        rows_ = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if not (held[p] and 100 * held[p] >= percent * a):
                rows_.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -score) for k, (score, a, p, l, r) in enumerate(sorted(rows_)[:first])]
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    parts = ["of the", "the", "water", "a b c d", "Garden, tree", "x.", "été", "\t", "  ", "\n", "tree!", "12", "of the garden", "of", "\x0b", "a b c d e", "É", "the the the the the"]
    return [(rng.choice(["en", "fr", None]), rng.choice([None, "", " , ", "z" * 200] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 70)))] * 9)) for _ in range(n)]


@pytest.mark.parametrize("seed, longest, least, size, batch", [(1, 4, 3, 12 << 20, 400_000), (2, 4, 5, 300, 7), (3, 2, 2, 50, 1), (4, 5, 4, 1, 100), (5, 4, 3, 80, 50)])
def test_collocations(spark, monkeypatch, seed, longest, least, size, batch):
    rows = corpus(seed)
    assert collocations_brute(rows, longest, least)
    table = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("clash") for c in ("shard", "code", "word", "n", "phrase", "a", "size", "pair")}).repartition(3)
    monkeypatch.setattr(collocations, "SHARD_BYTES", size)
    monkeypatch.setattr(collocations, "BATCH", batch)
    monkeypatch.setattr(collocations, "FILTERED_PAIRS", 0 if seed % 2 else 1 << 24)
    monkeypatch.setattr(collocations, "LISTED_WORDS", 0 if seed < 3 else 1 << 21)
    for first in (2000, 5):
        got = collocations.collocations(table, longest, least, first)
        assert sorted(tuple(r) for r in got.collect()) == collocations_brute(rows, longest, least, first)
    assert collocations.collocations(table.filter("false"), longest, least).count() == 0


@pytest.mark.parametrize("size", [1, 4, 9, 1000])
def test_stretches_end_with_pieces(size):
    texts = [b"ab c. d", b"", b"e", b"long piece without an end", b"f,g,h,i,j,k", b""]
    bounds = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    parts = list(collocations._stretches(data, bounds, size))
    assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == len(data)
    for a, b in parts:
        assert b in bounds or chr(data[b - 1]) in ".,"
        assert b - a <= size or not any(a < e < b for e in bounds) and not set(b".,") & set(data[a : b - 1].tolist())


@pytest.mark.parametrize("seed", range(5))
def test_bitmaps(seed):
    rng = random.Random(seed)
    codes = np.array([rng.choice([-1, 0, 0, 0, 1, 2, 3, rng.randrange(40)]) for _ in range(rng.choice([1, 63, 64, 65, 1000]))], np.int64)
    want = Counter()
    for m in (2, 3, 4):
        for k in range(len(codes) - m + 1):
            if (codes[k : k + m] >= 0).all():
                want[tuple(codes[k : k + m].tolist())] += 1
    for pairs in (None, sorted({a << 32 | b for a, b in (p for p in want if len(p) == 2) if (a + b) % 3})):
        got = Counter()
        for names, n in collocations.Shard(codes).mined(4, None if pairs is None else np.array(pairs, np.int64)):
            for p, c in zip(names.tolist(), n.tolist()):
                assert tuple(p) not in got
                got[tuple(p)] = c
        ok = lambda p: pairs is None or all(a << 32 | b in pairs for a, b in zip(p, p[1:]))
        assert got == {p: c for p, c in want.items() if ok(p)}


def test_known_words():
    one = pa.table({"h": pa.array([5, -3, 9], pa.int64()), "check": pa.array([1, 2, 3], pa.int32()), "id": pa.array([70, 71, 72], pa.int64())})
    known = collocations.Known(one)
    have, ids = known.of(np.array([9, 4, -3, 5, 5], np.int64), np.array([3, 3, 2, 9, 1], np.int32))
    assert known.distinct and have.tolist() == [0, 2, 4] and ids.tolist() == [72, 71, 70]  # an equal first hash alone is no hit
    assert collocations.Known(one.slice(0, 0)).of(np.array([5], np.int64), np.array([1], np.int32))[0].tolist() == []
    assert not collocations.Known(pa.concat_tables([one, one])).distinct


def test_two_ids_of_words_go_as_one_number(spark):
    ids = [p << 33 | r for p in range(5) for r in range(p + 3)]
    one, bits = collocations._numbered(spark.createDataFrame([(i,) for i in ids], "id long"))
    got = [r["id"] for r in one.collect()]
    assert bits == 6 and len(set(got)) == len(ids) and max(got) < 1 << bits
    many = spark.createDataFrame([(0,), (1 << 32,)], "id long")
    assert [collocations._numbered(t)[1] for t in (many, many.filter("false"))] == [0, 1]


@pytest.mark.parametrize("columns, held", [(1, 1), (1, 30), (1, 10_000), (3, 1), (3, 50), (3, 10_000)])
def test_summed(columns, held):
    rng = np.random.default_rng(columns + held)
    parts = [(tuple(rng.integers(-3, 4, m) for _ in range(columns)), rng.integers(1, 9, m)) for m in (5, 0, 70, 1, 200)]
    want, got = Counter(), Counter()
    for keys, n in parts:
        for *k, c in zip(*keys, n):
            want[tuple(k)] += c
    out = list(collocations.summed(iter(parts), held))
    for keys, n in out:
        rows = list(zip(*keys))
        assert rows == sorted(set(rows))
        for k, c in zip(rows, n):
            got[k] += c
    assert got == want and all(len(n) >= held / 2 for _, n in out[:-1]) and (held < 10_000 or len(out) == 1)
    assert list(collocations.summed(iter([]), held)) == []


@pytest.mark.parametrize("bits", [3, 12, 20, 31, 0])
def test_phrases_as_numbers(spark, bits):
    ids = [0, 1, 2, 5, (1 << (bits or 62)) - 1]
    one = spark.createDataFrame([(i, "en", f"w{i % 97}") for i in ids], "id long, lang string, word string")
    found = [p for m in (3, 5) for p in itertools.product(ids, repeat=m)][::7]
    width, per, columns = collocations._packing(5, bits)
    rows = [tuple(int(c[0]) for c in collocations._packed(np.array([p], np.int64), width, per, len(columns))) for p in found]
    assert len(set(rows)) == len(found) and min(map(min, rows)) >= 0
    table = spark.createDataFrame([(*r, n) for k, r in enumerate(rows) for n in (2, k % 5)], ", ".join(f"{c} long" for c in [*columns, "n"])).repartition(3)
    got = {(r["lang"], r["phrase"], r["size"], r["a"]) for r in collocations._frequent_longer(table, one, 5, bits, 4).collect()}
    assert got == {("en", " ".join(f"w{i % 97}" for i in p), len(p), 2 + k % 5) for k, p in enumerate(found) if k % 5 > 1}


@pytest.mark.parametrize("listed", [True, False])
def test_few_shards_at_once(spark, monkeypatch, listed):
    """However many shards a task has, a row group and a batch hold few of them, and a pair leaves the task once."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", 50)
    monkeypatch.setattr(collocations, "LISTED_WORDS", 1 << 21 if listed else 0)
    groups, batches, pairs = [], spark.sparkContext.accumulator(0), []
    kept, opened, mined = collocations.written, collocations._open, collocations._pairs

    def written(df, what, *args, **kwargs):
        out = kept(df, what, *args, **kwargs)
        if what == "shards":
            files = [pq.ParquetFile(f.removeprefix("file:")) for f in out.inputFiles()]
            groups.extend(f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups))
        return out

    def counted(batch, i, known):
        batches.add(batch.num_rows > collocations.SHARDS_AT_ONCE)
        return opened(batch, i, known)

    def seen(shards, known, bits=0):
        one_task = kept(mined(shards.coalesce(1), known, bits), "seen", batch_rows=collocations.SHARDS_AT_ONCE)
        pairs.append((bits, one_task.groupBy("pair").count().agg(F.max("count")).first()[0]))
        return mined(shards, known, bits)

    for name, f in (("written", written), ("_open", counted), ("_pairs", seen)):
        monkeypatch.setattr(collocations, name, f)
    table = spark.createDataFrame(corpus(7), "lang string, text string").coalesce(1)
    assert collocations.phrases(table, 4, 3)[0].count()
    assert sum(groups) > 50 and max(groups) <= collocations.SHARDS_AT_ONCE and batches.value == 0
    assert pairs[0][0] and pairs[0][1] == 1
    assert spark.conf.get(common._BATCH, None) is None
