"""Operator 10 against brute force: windows, blocks, dealt anchors, and the transform's prefixes."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hashing, repeats

from .test_operators import ROWS, by_id, docs, none  # noqa: F401


def cut_brute(rows, length=50):
    where = {}
    for i, x in rows:
        b = (x or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                where[w] = min(where.get(w, i), i)
    out = []
    for i, x in rows:
        b = (x or "").encode()
        marked = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - length + 1):
                if where[b[k : k + length]] < i:
                    marked[k : k + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, marked) if not m)
        spans = sum(1 for k in range(len(marked)) if marked[k] and not (k and marked[k - 1]))
        out.append((i, len(b), sum(marked), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("group", [1, 3, repeats.GROUP])
def test_repeats(spark, docs, tmp_path, monkeypatch, group):  # noqa: F811
    monkeypatch.setattr(repeats, "GROUP", group)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert by_id(repeats.op10_suffix_array_dedup(spark, str(tmp_path)), *COLUMNS) == cut_brute(ROWS)


@pytest.mark.parametrize("group", [2, repeats.GROUP])
def test_a_common_line_in_ever_new_contexts(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, other = text(12), text(9)
    rows = [(i, f"{text(rng.randint(0, 9))}{line if i % 4 else line[:-9]}{text(rng.randint(0, 9))}{other * (i % 3)}{text(4)}") for i in range(120)]
    rows += [(7, rows[3][1] + "x"), (200, rows[3][1]), (201, rows[3][1][:90] * 3), (5, rows[5][1]), (None, line), (-3, other), (202, "\x00" * 70 + line), (203, "\x00" * 99)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert by_id(repeats.op10_suffix_array_dedup(spark, str(tmp_path)), *COLUMNS) == cut_brute(rows)


def test_repeats_of_an_empty_table(spark, none, tmp_path):  # noqa: F811
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert repeats.op10_suffix_array_dedup(spark, str(tmp_path)).count() == 0


def test_columns_pass_with_clashing_names(docs, none):  # noqa: F811
    got = repeats.cut_documents(docs.withColumn("doc", F.lit(1)).withColumn("told", F.lit(2)))
    assert got.select("doc.doc", "doc.told", "doc.starts", "kept_text").distinct().count() > 5
    assert {r["doc_id"]: r["kept_text"] for r in got.select("doc.doc_id", "kept_text").collect()}[1] is None
    assert repeats.cut_documents(none).count() == 0


def test_prefixes_derived_from_the_transform_equal_compared_ones():
    rng = random.Random(4)
    for n, letters in ((1, "a"), (40, "a"), (300, "ab"), (500, "abc"), (700, "abcdefgh")):
        text = np.frombuffer("".join(rng.choice(letters) for _ in range(n)).encode() * (2 if n == 300 else 1), np.uint8)
        for depth in (1, 5, 23):
            order = repeats.suffix_order(text, depth)
            around = np.resize(text, 3 * len(text) + 3 * depth).tobytes()
            rows = [around[i : i + depth] for i in order.tolist()]
            assert rows == sorted(rows)
            want = [0] + [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(rows, rows[1:])]
            assert repeats.common_prefixes(text, order, depth).tolist() == want


def test_expansion_equals_window_by_window():
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"xyz") for _ in range(rng.randint(2, 14))) + b"m" * rng.randint(0, 30) for _ in range(60)]
    first = np.array([rng.randint(0, 1000) for _ in parts])
    for length in (8, 30):
        seen = {}
        for s, f in zip(parts, first):
            for k in range(len(s) - length + 1):
                seen[s[k : k + length]] = min(f, seen.get(s[k : k + length], f))
        part, start, least = repeats.expand(parts, first, length)
        raw = b"".join(parts)
        assert len(part) == sum(max(0, len(s) - length + 1) for s in parts)
        for p, a, got in zip(part, start, least):
            assert got == seen[raw[a : a + length]] and raw[a : a + length] in parts[p]


def test_anchors_and_names_do_not_depend_on_the_block():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 100, 400).astype(np.uint8) for _ in range(3)] + [np.full(300, 97, np.uint8)]
    whole, bounds = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]

    def every(data, bounds):
        row, _, _, _, _, left, right = repeats.anchored(data, bounds, 50, repeats.content_hash(data))
        return np.unique(np.r_[row, row].astype(np.uint64) << repeats._KEY_BITS | np.r_[left, right])

    row, _, s0, s1, cid = repeats.stretches(whole, bounds, every(whole, bounds), 50)
    for i, text in enumerate(texts):
        own = np.array([0, len(text)])
        _, _, a, b, name = repeats.stretches(text, own, every(text, own), 50)
        assert (a + bounds[i]).tolist() == s0[row == i].tolist() and (b + bounds[i]).tolist() == s1[row == i].tolist() and name.tolist() == cid[row == i].tolist()
        assert (s1 - s0 + 1)[row == i].sum() == len(text) - 49


def test_blocks_of_any_size_find_the_same(monkeypatch):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("ab ") for _ in range(150))
    common = text()
    texts = [text() + common[: rng.randint(60, 150)] + text() for _ in range(12)]
    found = []
    for size in (1, 1000, 1 << 20):
        monkeypatch.setattr(hashing, "BLOCK_BYTES", size)
        names = []
        for at, data, bounds in hashing.text_blocks(pa.array(texts)):
            row, h, _, _, _, left, right = repeats.anchored(data, bounds, 50, repeats.content_hash(data))
            names += list(zip((row + at).tolist(), h.tolist(), left.tolist(), right.tolist()))
        found.append(sorted(names))
    assert found[0] == found[1] == found[2]
