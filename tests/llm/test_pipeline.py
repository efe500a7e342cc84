"""The pipeline's stages replayed by brute force, and its awkward inputs."""

from pyspark.sql import functions as F

from .test_operators import ROWS, SF, docs, near_classes, none, sentence, shingles  # noqa: F401
from .test_repeats import cut_brute


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
    start = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = [(i, x) for i, x in start if x and any(map(str.isalpha, x))]
    assert sorted(r["doc_id"] for r in seen["language_id"].collect()) == sorted(i for i, _ in kept)
    comp, _ = near_classes(kept, 80)
    left = [(i, x) for i, x in kept if comp[i] == i]
    assert sorted(r["doc_id"] for r in seen["near_dedup"].collect()) == sorted(i for i, _ in left)
    lost = {i: n for i, _, n, _, _ in cut_brute(left)}
    after = {r["doc_id"]: r for r in seen["suffix_array_dedup"].collect()}
    for i, x in left:
        if lost[i] == len(x.encode()):
            assert i not in after
        elif lost[i] == 0:
            assert after[i]["text"] == x
        else:
            assert len(x.encode()) - lost[i] - 6 <= len(after[i]["text"].encode()) <= len(x.encode()) - lost[i] and after[i]["n_chars"] == len(after[i]["text"])
    assert {r["doc_id"] for r in docs.collect()} == set(after)


def test_pipeline_links_near_copies_from_80_percent(spark):
    import corpus_pipeline as p

    words = [f"w{i}" for i in range(104)]
    near, far = [f"x{i}" if i > 92 else w for i, w in enumerate(words)], [f"y{i}" if i > 90 else w for i, w in enumerate(words)]
    rows = [(i, " ".join(w)) for i, w in enumerate((words, near, far))]
    a, b, c = (shingles(x) for _, x in rows)
    assert 0.8 <= len(a & b) / len(a | b) < 0.85 and len(a & c) / len(a | c) < 0.8
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in p.near_dedup(spark, docs, SF).collect()}
    assert 0 in kept and 1 not in kept and (2 in kept) == (100 * len(b & c) < 80 * len(b | c))


def test_awkward_rows_and_columns(spark, docs, none):  # noqa: F811
    import corpus_pipeline as p

    extra = {c: F.lit("mine") for c in ("doc", "kept_text", "whole", "lang_spans", "lang_score", "told", "component_id")}
    odd = docs.withColumns(extra).withColumn("text", F.coalesce("text", F.lit(None).cast("string")))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert {r[c] for r in rows for c in extra} <= {"mine"} and all(r["row"] == "clash" and r["lang_pred"] == "clash" for r in rows), name
        assert stage(spark, none.withColumns(extra), SF).count() == 0, name
    assert None in {r["doc_id"] for r in p.near_dedup(spark, odd, SF).collect()}
    assert sorted(r["doc_id"] for r in p.near_dedup(spark, odd, SF).filter("doc_id is not null").collect()).count(4) == 2  # a repeated row is no copy of itself
    assert {r["doc_id"] for r in p.repeats(spark, odd, SF).filter("text is null").collect()} == {1}
    assert p.packing(spark, none, SF).count() == 0
