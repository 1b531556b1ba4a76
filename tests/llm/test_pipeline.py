"""The pipeline on small tables: each stage does its work on all that the one before it kept."""

import os
import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")
DATA = "/root/testdata/sf0.001"
WINDOW = 50


def brute_kept(rows):
    """The bytes of each (id, text) that no window starting in a smaller id covers."""
    first, out = {}, {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        for p in range(len(data) - WINDOW + 1):
            first.setdefault(data[p : p + WINDOW], d)
    for d, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - WINDOW + 1):
            if first[data[p : p + WINDOW]] < d:
                gone[p : p + WINDOW] = True
        out[d] = np.frombuffer(data, "u1")[~gone].tobytes().decode("utf-8", "ignore")
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, columns, texts = [docs.count()], docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, DATA), f"test-{name}")
        if k < 4:
            assert docs.columns == columns
            kept.append(docs.count())
            texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert kept[0] > kept[1] > kept[2] == kept[3] == kept[4] > 0.7 * kept[0]
    assert texts[2] == brute_kept(texts[1].items())
    # Pseudonyms stand where the finds stood, and are as long.
    assert all(len(texts[3][d]) == len(t) for d, t in texts[2].items()) and texts[3] != texts[2]
    library = tokenizers.Tokenizer.from_file(corpus_pipeline.packing.default_vocabulary())
    pieces = {}
    for r in docs.collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(pieces) == set(texts[3])
    for d, own in pieces.items():
        n = len(library.encode(texts[3][d] or "", add_special_tokens=False).ids) + 1
        own.sort()
        assert {x[2] for x in own} == {n} and [x[0] for x in own] == [sum(y[1] for y in own[:k]) for k in range(len(own))] and sum(x[1] for x in own) == n


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_toxic_documents_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, docs, DATA).collect()}
    clean, toxic = ([d in kept for d, t in labels.items() if t == want] for want in (0, 1))
    assert sum(clean) / len(clean) > 0.95 and sum(toxic) / len(toxic) < 0.2


def odd_documents(spark):
    """Nulls in every column, repeated rows, short, empty and very long texts, and columns that clash with names used within."""
    random.seed(4)
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in range(500)]
    rows = [(i, " ".join(random.choices(words, k=80)), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [rows[3], rows[3], (50, rows[5][1] + " more", None, None, None), (51, None, "en", "", 0), (52, "", None, "s1", None), (None, rows[7][1], "de", "s2", 1)]
    rows += [(None, None, None, None, None), (53, "x", "en", "s1", 1), (54, " ".join(random.choices(words, k=30_000)), "en", "s0", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("part", "sha", "id", "queue", "fp", "rep", "key", "n", "bits", "digest", "component", "p_toxic", "least", "ids", "media", "y", "fold")
    return docs.selectExpr("*", *(f"{k} as {c}" for k, c in enumerate(clash)))


def test_odd_tables(spark, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(1, 1, 0), (None, 1, 1), (3, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_documents(spark)
    columns, texts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        if k < 4:
            assert docs.columns == columns
            texts.append(sorted((str(r["doc_id"]), r["text"] or "", r["p_toxic"]) for r in docs.collect()))
    assert len(texts[0]) == 49  # labels of one class: nothing is rejected
    # Of the near copies 5 and 50, and of the texts without words, the smallest id stays; rows without an id are linked to none.
    gone = {"50", "52"}
    assert [r[0] for r in texts[1]] == sorted(d for d, *_ in texts[0] if d not in gone) and len(texts[2]) == len(texts[3]) == len(texts[1])
    assert all(p == 11 for _, _, p in texts[3])
    rows = docs.collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == sum(r["doc_tokens"] for r in rows if r["doc_id"] == 3 and r["start"] == 0)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_documents(spark).limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"empty-{name}")
        assert docs.count() == 0 and (k == 4 or docs.columns == odd_documents(spark).columns)


def test_run_leaves_the_packed_pieces_alone(spark, tmp_path):
    """Intermediate tables are removed behind the stages, and the result can still be read."""
    odd_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} >= {0, 54, None}
