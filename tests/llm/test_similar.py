"""Near-duplicate groups against the Jaccard similarity of all pairs."""

import os
import random

import numpy as np
import pytest

from askwell.llm import similar

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def brute_groups(rows, least=0.8):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            both = len(x & y)
            if both >= least * (len(x) + len(y) - both) - 1e-9:
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: root(d) for d, _ in rows}


def groups(spark, rows):
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return {d: found.get(d, d) for d, _ in rows}


def words(n):
    return ["".join(random.choices("abcdefgh", k=7)) for _ in range(n)]


def test_appended_and_truncated_copies(spark):
    random.seed(1)
    rows = []
    for k in range(100):
        base = words(150 + k)
        extra = words(int((len(base) - 4) * random.uniform(0.0, 0.24)))
        copy = base + extra if k % 3 == 0 else extra + base if k % 3 == 1 else base[: len(base) - len(extra) * 4 // 5]
        rows += [(k, " ".join(base)), (1000 + k, " ".join(copy))]
    want = brute_groups(rows)
    assert groups(spark, rows) == want and sum(a != b for a, b in want.items()) == 100


def test_similarities_round_the_threshold(spark):
    random.seed(2)
    rows = []
    for k in range(150):
        base = words(random.choice((4, 8, 9, 60, 200)))
        n = len(base)
        copy = base + words(max(1, round(n * random.uniform(0.05, 0.42)))) if k % 2 else list(base)
        for at in random.sample(range(n), max(1, n // 60)) if k % 2 == 0 else ():
            copy[at] = words(1)[0]
        rows += [(k, " ".join(base)), (1000 + k, " ".join(copy))]
    want = brute_groups(rows)
    assert groups(spark, rows) == want and 40 < sum(a != b for a, b in want.items()) < 120


def test_crowded_keys(spark):
    """Different texts that share common lines stand between the copies in order of ids."""
    random.seed(3)
    common = words(60)
    rows = []
    for k in range(150):
        rows.append((k, " ".join(common + words(8))))
    for k in range(40):
        text = rows[3 * k][1].split()
        text[-1] = words(1)[0]
        rows.append((1000 - k, " ".join(text[random.randrange(3) :])))
    rows += [(2000 + k, " ".join(words(1) + common[:50] + words(9))) for k in range(60)]
    rows += [(3000 + k, " ".join(common[20:] + rows[190 + k][1].split()[51:])) for k in range(60)]
    random.shuffle(rows)
    assert groups(spark, rows) == brute_groups(rows)


def test_rows_between_groups_do_not_grow_with_the_square(spark, monkeypatch):
    """Texts of 14 passages in two forms each: most share many, few are similar; pairs under crowded keys become no rows."""
    random.seed(4)
    forms = [(words(10), words(10)) for _ in range(14)]
    rows = [(k, " ".join(w for form in forms for w in form[random.random() < 0.25])) for k in range(200)]
    counted = []
    for name in ("_to_compare", "_between_groups"):
        made = getattr(similar, name)
        monkeypatch.setattr(similar, name, lambda *a, made=made, **b: counted.append((out := made(*a, **b)).count()) or out)
    assert groups(spark, rows) == brute_groups(rows)
    compared, linked = counted
    assert 0 < compared < 28 * len(rows) and 0 < linked < len(rows)


def test_pairs_meet_under_their_first_common_key():
    before = [np.array(v, "i8") for v in ([], [5, -7], [9, 5], [], [3])]
    x, y = np.triu_indices(5, 1)
    assert similar._no_earlier(before, x, y).tolist() == [not set(before[a]) & set(before[b]) for a, b in zip(x.tolist(), y.tolist(), strict=True)]


def test_stage_on_the_smallest_table(spark):
    if not os.path.isdir(DATA):
        pytest.skip("needs the test tables")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute_groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, DATA).select("doc_id").collect()}
    assert kept == {d for d, g in want.items() if d == g}
