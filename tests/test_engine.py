"""Golden values and brute-force comparisons of the engine's operators."""

import hashlib
import json
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from askwell.functions.vectors import entropy_confidence, softmax, sums_before
from askwell.operators import ask as A
from askwell.operators import builders as J
from askwell.operators import chunking as C
from askwell.operators import embedding
from askwell.operators import evaluate as I
from askwell.operators import retrieval as R
from askwell.operators import scoring as S
from askwell.plans.engine import Engine
from askwell.plans.service import Service, index_key, plain
from askwell.plans.validation import IndexCache, Limits, Refusal, validate
from askwell.sources import files

CAT = ["the cat sat", "a dog barked", "cat and cat again", "", "dog dog cat"]


def passages(spark, texts, doc=1):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc_id long, index int, text string")


@pytest.mark.parametrize(
    "query,scores,order",
    [
        ("cat", [0.504097, 0, 0.656389, 0, 0.504097], [2, 0, 4, 1, 3]),
        ("cat cat", [1.008194, 0, 1.312778, 0, 1.008194], [2, 0, 4, 1, 3]),
        ("dog cat", [0.504097, 0.818784, 0.656389, 0, 1.695835], [4, 1, 2, 0, 3]),
        ("zebra", [0] * 5, [0, 1, 2, 3, 4]),
        ("", [0] * 5, [0, 1, 2, 3, 4]),
    ],
)
def test_bm25(spark, query, scores, order):
    rows = R.ranked(R.bm25_scores(passages(spark, CAT), [("q", query)])).collect()
    assert [r["score"] for r in sorted(rows, key=lambda r: r["index"])] == pytest.approx(scores, abs=2e-6)
    assert [r["index"] for r in sorted(rows, key=lambda r: r["pos"])] == order


def windows(text, size, stride):
    """The loop that the closed form stands for."""
    t = [m.span() for m in re.finditer(r"[^ \t\n\r\f]+", text)]
    n = len(t)
    if n <= size:
        return [(0, n, 0, len(text))]
    out, a = [], 0
    while True:
        b = min(n, a + size)
        out.append([a, b])
        if b >= n:
            break
        a += stride
    if len(out) > 1 and out[-1][1] - out[-1][0] < size // 4:
        out.pop()
        out[-1][1] = n
    return [(a, b, t[a][0], t[b - 1][1]) for a, b in out]


def test_token_windows(spark):
    random.seed(2)
    texts = [None, "", " a ", *("".join(random.choices(["a", "bc", " ", "\n", "é "], k=k)) for k in range(1, 120, 3))]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    for size, stride in ((20, 20), (20, 17), (20, 10), (7, 7)):
        got = {}
        for r in C.token_windows(docs, size, stride).orderBy("doc_id", "index").collect():
            t = texts[r["doc_id"]] or ""
            assert r["text"] == t[r["char_start"] : r["char_end"]]
            got.setdefault(r["doc_id"], []).append((r["tok_start"], r["tok_end"], r["char_start"], r["char_end"]))
        assert got == {i: windows(t or "", size, stride) for i, t in enumerate(texts)}


def test_paragraphs(spark):
    texts = ["a b\n\n \n\nc", "  ", "\n\n", "x " * 50, None, "one.two"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    rows = C.paragraphs(docs).orderBy("doc_id", "index").collect()
    assert [(r["doc_id"], r["index"], r["text"], r["tok_start"], r["tok_end"]) for r in rows if r["doc_id"] in (0, 1, 2, 4)] == [
        (0, 0, "a b", 0, 2), (0, 1, "c", 2, 3), (1, 0, "  ", 0, 0), (2, 0, "\n\n", 0, 0), (4, 0, "", 0, 0)
    ]
    assert all(r["text"] == (texts[r["doc_id"]] or "")[r["char_start"] : r["char_end"]] for r in rows)
    cut = C.paragraphs(docs, max_tokens=20).where("doc_id = 3").orderBy("index").collect()
    assert [(r["tok_start"], r["tok_end"]) for r in cut] == [(a, b) for a, b, _, _ in windows(texts[3], 20, 10)]
    assert [r["text"] for r in C.paragraphs(docs, ".").where("doc_id = 5").orderBy("index").collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        C.check_windows(10, 11)
    with pytest.raises(ValueError):
        C.chunked(docs, "words")


def test_vectors(spark):
    r = spark.sql("select array(1D, 2D, 3D) as z, array(0.55D, 0.3D, 0.15D) as p").select(softmax("z").alias("s"), entropy_confidence("p").alias("c")).first()
    assert r["s"] == pytest.approx([0.090031, 0.244728, 0.665241], abs=1e-6)
    assert r["c"] == pytest.approx(0.112908, abs=1e-6)


def test_pools(spark):
    rows = spark.createDataFrame([([0.7, 0.2, 0.1], 0.9), ([0.1, 0.6, 0.3], 0.3)], "p array<double>, g double")
    rows = rows.withColumn("k", F.lit(1))
    r = rows.groupBy("k").agg(A.choice_mixture("p", "g", 3).alias("m"), A.choice_loglinear_logits("p", "g", 3).alias("l")).withColumn("l", softmax("l")).first()
    assert r["m"] == pytest.approx([0.55, 0.30, 0.15])
    assert r["l"] == pytest.approx([0.521528, 0.318981, 0.159491], abs=1e-6)
    n = spark.createDataFrame([(0.2,), (0.5,), (0.9,)], "p double").withColumn("g", F.lit(0.0))
    r = n.agg(A.noul_any("p").alias("a"), A.noul_mean("p", "g").alias("m"), A.noul_max("p").alias("x")).first()
    assert (r["a"], r["m"], r["x"]) == pytest.approx((0.96, 0.533333, 0.9), abs=1e-6)


NOUL = S.Question("n", "noul", "dog")
PICK = S.Question("c", "choice", "which", (("cat", "cat"), ("dog", "dog")))


def test_ask(spark):
    docs = spark.createDataFrame([(1, "the cat sat\n\na dog barked\n\ncat cat"), (2, "a dog")], "doc_id long, text string")
    e = Engine(mode="paragraphs", chunk_tokens=20)
    got = {(r["doc_id"], r["qid"]): r for r in e.ask(docs, [NOUL, PICK], detail=True).collect()}
    assert got[1, "n"]["answer_value"] == pytest.approx(0.5) and got[1, "n"]["n_scored"] == 3
    assert got[1, "c"]["answer_key"] == "cat" and [c["index"] for c in got[1, "c"]["chunks"]] == [0, 1, 2]
    assert got[2, "c"]["answer_key"] == "dog" and got[2, "c"]["chunks"][0]["gate"] == 1.0  # one passage: no gate
    top = Engine(mode="paragraphs", chunk_tokens=20, prefilter="bm25", top_k=1)
    found = {r["doc_id"]: r for r in top.ask(docs, [NOUL], detail=True).collect()}
    assert [c["index"] for c in found[1]["chunks"]] == [1] and found[1]["n_chunks"] == 3
    index = e.index(docs)
    again = {(r["doc_id"], r["qid"]): r for r in e.ask(index, [NOUL, PICK], detail=True).collect()}
    assert again == got
    with pytest.raises(ValueError):
        Engine(chunk_tokens=10).ask(index, [NOUL])
    index.close()


class Counting:
    """A model that writes down how many rows it is asked."""

    def __init__(self, path):
        self.path = path

    def __call__(self, texts, q):
        with open(f"{self.path}/{os.getpid()}", "a") as f:
            f.write(f"{q.qid}\n" * len(texts))
        return [[0.0] * (len(q.keys) - 1) + [float(len(t) % 3)] for t in texts]


@pytest.mark.parametrize("prefilter", (None, "bm25"))
def test_rows_scored_are_those_estimated(spark, tmp_path, prefilter):
    docs = spark.createDataFrame([(1, "the cat sat\n\na dog barked\n\ncat cat"), (2, "a dog")], "doc_id long, text string")
    chunks = C.paragraphs(docs, counted=True)
    level = S.Question("s", "score", "how many", (("no cat", None), ("a cat", None)))
    seen = S.Question("d", "noul", "cat", detector=S.Question("x", "choice", "cat", (("cat", None), ("dog", None))), detector_key="dog")
    for n, questions in enumerate(([NOUL], [NOUL, PICK], [NOUL, PICK, level, seen])):
        folder = tmp_path / str(n)
        folder.mkdir()
        scorer = S.ArrowScorer(lambda folder=str(folder): Counting(folder), 2)
        got = A.ask(chunks, questions, prefilter, 2, scorer=scorer).collect()
        assert len(got) == 2 * len(questions)
        asked = [line for f in folder.iterdir() for line in f.read_text().split()]
        estimate = A.row_estimate(chunks, questions, prefilter, 2).agg(F.sum("rows")).first()[0]
        assert len(asked) == estimate and sum(r["n_scored"] for r in got) == sum(not a.endswith("__gate") for a in asked)


def test_ids_and_gates_as_they_are(spark):
    q = S.Question("it's \\ a 'q'", "choice", "which", (("c'at", "cat"), ("d\\og", "dog")))
    docs = spark.createDataFrame([(1, "the cat sat\n\na dog barked\n\ncat cat"), (2, "a dog")], "doc_id long, text string")
    for top in (None, "bm25"):
        got = {r["doc_id"]: r for r in Engine(mode="paragraphs", chunk_tokens=20, prefilter=top, top_k=2).ask(docs, [q, NOUL]).where("qid <> 'n'").collect()}
        assert got[2]["qid"] == q.qid and got[2]["answer_key"] == "d\\og" and got[1]["answer_key"] == "c'at" and got[2]["agg"] == "passthrough"
    # Only the passage of the gate's own word is relevant.
    gated = Engine(mode="paragraphs", chunk_tokens=20, template="dog", scorer=S.LexicalScorer(50.0, 20.0))
    assert {r["doc_id"]: r["answer_key"] for r in gated.ask(docs, [PICK]).collect()} == {1: "dog", 2: "dog"}
    with pytest.raises(ValueError):
        A.ask(C.paragraphs(docs), [NOUL, NOUL]).count()


def test_stack(spark):
    """The second state has the passages by falling relevance with the answers that the first pass gave."""
    docs = spark.createDataFrame([(1, "the cat sat\n\na dog barked which\n\ncat cat"), (2, "a dog")], "doc_id long, text string")
    chunks = C.paragraphs(docs, counted=True)
    level = S.Question("s", "score", "how", (("none", None), ("cat", None)))
    rows = A.scored_rows(A.selected_passages(chunks, [PICK, level], None, 1), [PICK, level])
    states = {(r["doc_id"], r["qid"]): json.loads(r["state"]) for r in A.pooled(rows, [PICK, level], {"choice": "stack", "score": "stack"}, states=True).collect()}
    parts = states[1, "c"]["parts"]
    gates = {r["index"] + 1: round(r["gate"], 2) for r in rows.where("qid = 'c' and doc_id = 1").collect()}
    assert [p["part"] for p in parts] == sorted(gates, key=lambda k: (-gates[k], k)) and {p["part"]: p["relevance"] for p in parts} == gates
    assert {p["part"]: p["answer"] for p in parts} == {1: "cat", 2: "dog", 3: "cat"} and parts[0]["p"] == 0.67
    assert {p["part"]: p["score"] for p in states[1, "s"]["parts"]} == {1: 0.67, 2: 0.5, 3: 0.67} and states[1, "c"]["note"] == A.STACK_NOTE
    plain = A.pooled(A.scored_rows(A.selected_passages(chunks, [PICK], None, 1), [PICK], False), [PICK], {"c": "stack"}, states=True, gate=False)
    assert "relevance" not in json.loads(plain.where("doc_id = 1").first()["state"])["parts"][0]
    got = {(r["doc_id"], r["qid"]): r for r in A.ask(chunks, [PICK, level], agg={"choice": "stack", "score": "stack"}).collect()}
    mixed = {(r["doc_id"], r["qid"]): r for r in A.ask(chunks, [PICK, level]).collect()}
    assert got[1, "c"]["agg"] == "stack" and got[1, "c"]["answer_value"] == pytest.approx(0.5) != mixed[1, "c"]["answer_value"]
    assert got[2, "c"] == mixed[2, "c"] and got[1, "c"]["tokens"] == mixed[1, "c"]["tokens"]
    assert A.mode_of(NOUL, {"noul": "stack"}) == "mean"


def test_cached_scorer(spark, tmp_path):
    """A second run asks nothing, another checkpoint everything; equal rows are asked once."""
    folder, path = tmp_path / "calls", str(tmp_path / "cache")
    folder.mkdir()
    rows = passages(spark, [*CAT, CAT[0]])
    inner = S.ArrowScorer(lambda folder=str(folder): Counting(folder), 2)
    calls = lambda: sum(len(f.read_text().split()) for f in folder.iterdir())
    plain = {(r["index"], r["qid"]): list(r["logits"]) for r in inner.score(rows, [NOUL, PICK]).collect()}
    base, first = calls(), S.CachedScorer(inner, path)
    got = {(r["index"], r["qid"]): list(r["logits"]) for r in first.score(rows, [NOUL, PICK]).collect()}
    assert got == plain and calls() - base == 10
    again = S.CachedScorer(inner, path)
    assert {(r["index"], r["qid"]): list(r["logits"]) for r in again.score(rows, [NOUL, PICK]).collect()} == plain and calls() - base == 10
    S.CachedScorer(inner, path, checkpoint="b").score(rows, [NOUL]).collect()
    assert calls() - base == 15
    docs = spark.createDataFrame([(1, "the cat sat\n\na dog barked"), (2, "a dog")], "doc_id long, text string")
    e = lambda scorer: sorted(map(str, Engine(mode="paragraphs", chunk_tokens=20, scorer=scorer).ask(docs, [NOUL, PICK]).collect()))
    assert e(again) == e(inner)
    again.close()
    keys = rows.select(S.row_key("text", "text"), S.row_key("text", "text", 512), S.row_key("text", "text", None, 192), S.row_key("text", "text", checkpoint="x")).first()
    assert len(set(keys)) == 4


def test_more_options_than_the_scorer_has(spark):
    with pytest.raises(ValueError):
        S.ArrowScorer(lambda: None, max_options=1).score(passages(spark, CAT), [PICK])


def test_act_chances(spark):
    docs = spark.createDataFrame([(1, "the cat sat\n\na dog barked"), (2, "a dog")], "doc_id long, text string")
    scorer = S.ArrowScorer(lambda: lambda texts, q: [([0.0, 1.0], len(t) / 100) for t in texts])
    got = {r["doc_id"]: r["act"] for r in A.ask(C.paragraphs(docs), [NOUL], scorer=scorer, detail=True).collect()}
    assert got[2] == pytest.approx(0.05) and got[1] == pytest.approx(0.12)


def test_sums_before(spark):
    import itertools

    for n in (0, 1, 2, 3, 10, 99, 100, 101):
        values = [k * 7 % 5 for k in range(n)]
        got = spark.sql(f"select {sums_before(f'cast(array({str(values)[1:-1]}) as array<bigint>)')} as s").first()["s"]
        assert got == [0, *itertools.accumulate(values)][:n]


def test_unicode_blanks(spark):
    texts = ["a\n\u3000\u00a0\x1c\n b", "\u2003", "x\n\u200b"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    got = {}
    for r in C.paragraphs(docs, "\n").orderBy("doc_id", "index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: [p for p in t.split("\n") if p.strip()] or [t] for i, t in enumerate(texts)}


def test_passages_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b\n\nc")], "doc_id long, text string")
    for df in (C.paragraphs(docs), C.paragraphs(docs, max_tokens=1), C.token_windows(docs, 2), A.scored_rows(A.selected_passages(C.paragraphs(docs, counted=True), [NOUL], None, 1), [NOUL])):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    plan = A.ask(C.paragraphs(docs, counted=True), [NOUL, PICK], "bm25", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_detector_only_where_several(spark):
    q = S.Question("n", "noul", "zzz", detector=PICK, detector_key="dog")
    docs = spark.createDataFrame([(1, "a dog\n\nx"), (2, "a dog")], "doc_id long, text string")
    got = {r["doc_id"]: r["answer_value"] for r in A.ask(C.paragraphs(docs), [q]).collect()}
    assert got[1] == pytest.approx(2 / 3, abs=1e-6) and got[2] == pytest.approx(1 / (1 + math.e), abs=1e-6)
    with pytest.raises(ValueError):
        S.Question("c", "choice", "x", PICK.options, detector=PICK, detector_key="dog")


def test_modes():
    assert A.mode_of(NOUL, {"noul": "any"}) == "any" and A.mode_of(NOUL, {"n": "nonsense"}) == "mean"
    assert A.mode_of(PICK, {"c": "nonsense"}) == "mixture"
    assert S.query_text(S.Question("c", "choice", "q", (("a", None), ("b", "m")))) == "q None m"
    assert S.query_text(S.Question("c", "choice", "q", (("a", None), ("b", "m"))), skip_null=True) == "q m"
    a, b = S.Question("c", "choice", "q", (("a", "1"), ("b", "2"))), S.Question("c", "choice", "q", (("b", "2"), ("a", "1")))
    assert S.question_json(a) == S.question_json(b)


def test_arrow_scorer_matches_expressions(spark):
    rows = passages(spark, CAT)

    def factory():
        def model(texts, q):
            out = []
            for t in texts:
                words = set(re.findall("[a-z0-9]+", t.lower()))
                out.append([math.log(1 + len(words & set(R.query_terms(m or k)))) for k, m in q.options])
            return out

        return model

    a = {r["index"]: list(r["logits"]) for r in S.ArrowScorer(factory, 2).score(rows, [PICK]).collect()}
    b = {r["index"]: list(r["logits"]) for r in S.LexicalScorer().score(rows, [PICK]).collect()}
    assert a == {k: pytest.approx(v) for k, v in b.items()}


def brute_auc(pos, neg):
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


def test_metrics(spark):
    pos, neg = [0.9, 0.5, 0.1], [0.5, 0.1, 0.7]
    rows = spark.createDataFrame([(s, True) for s in pos] + [(s, False) for s in neg], "score double, gold boolean")
    assert I.auc(rows).first()["auc"] == pytest.approx(brute_auc(pos, neg), abs=1e-6)
    assert tuple(I.recall_at_spec(rows).first()) == pytest.approx((0.7, 0.333333), abs=1e-6)
    assert I.auc(rows.where("gold")).first()["auc"] is None
    q = I.order_quartiles(spark.createDataFrame([(float(i),) for i in range(10)], "score double")).first()
    assert tuple(q) == (2.0, 5.0, 7.0)
    boot = I.auc_bootstrap(rows.withColumn("id", F.monotonically_increasing_id()), "id", 50).first()
    assert boot["lo"] <= 0.56 <= boot["hi"]


def test_rrf(spark):
    r = [spark.createDataFrame([("q", i, p) for p, i in enumerate(o)], "qid string, index int, pos int") for o in ([2, 0, 1], [0, 1, 2])]
    got = {x["index"]: (x["rrf"], x["pos"]) for x in R.fused(r, ["qid"]).collect()}
    assert {k: v[1] for k, v in got.items()} == {0: 0, 2: 1, 1: 2}
    assert [got[i][0] for i in range(3)] == pytest.approx([0.033060, 0.032522, 0.032796], abs=1e-6)


@pytest.mark.parametrize("block", (1024, 3))
def test_dense_ranks(spark, monkeypatch, block):
    """Against all pairs, in several blocks of queries and partitions; ties go by id."""
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    random.seed(4)
    rows = [(i, [float(random.randint(-2, 2)) for _ in range(3)], random.choice([0, 1, None]) if i else 7) for i in range(60)]
    v = spark.createDataFrame([*rows, (99, None, 1), (None, [1.0, 1.0, 1.0], 1)], "id long, v array<double>, label int").repartition(5)
    q = spark.createDataFrame([(i, x, y) for i, x, y in rows if i % 6 == 0], "qid long, v array<double>, want int")
    near, place = {}, {}
    for qid, x, want in ((i, x, y) for i, x, y in rows if i % 6 == 0):
        order = sorted(rows, key=lambda r: (-sum(a * b for a, b in zip(r[1], x, strict=True)), r[0]))
        near[qid] = [r[0] for r in order[:7]]
        place[qid] = next((k for k, r in enumerate(order) if r[2] is not None and r[2] == want and r[0] != qid), None)
    got = {}
    for r in R.dense_top_k(v.select("id", "v"), q.select("qid", "v"), 7).orderBy("qid", "pos").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == near and {r["qid"]: r["pos"] for r in R.target_ranks(v, q).collect()} == place and place[0] is None
    assert R.dense_top_k(v.select("id", "v"), q.limit(0).select("qid", "v")).count() == 0 and R.target_ranks(v, q.limit(0)).count() == 0


def test_builders(spark):
    a = spark.sql("select array('a', 'b', 'c') as a")
    place = lambda w: a.select(J.place(F.col("a"), F.lit("N"), w).alias("x")).first()["x"]
    assert place("start") == ["N", "a", "b", "c"] and place("middle") == ["a", "N", "b", "c"] and place("end")[-1] == "N" and place("none") == ["a", "b", "c"]
    rows = spark.createDataFrame([(1, i, 10) for i in range(6)], "g int, i int, n int")
    assert J.token_budget_fill(rows, "g", [F.col("i")], "n", 25).count() == 3
    assert J.offset_prefix(rows, "g", [F.col("i")], "n", 25).first()["n_before"] == 2


def test_validation():
    ok = {"state": [{"text": "a", "rubric": "be strict"}], "questions": {"q": {"type": "noul", "instructions": "x"}}}
    assert validate(ok)["questions"]["q"]["instructions"].endswith("Rubric: be strict")
    for change, code in (({"detail": 1}, "detail"), ({"strategy": "x"}, "strategy"), ({"agg": {"q": "mixture"}}, "agg_mode"), ({"detectors": {"z": {}}}, "detector_target"), ({"state": [1, 2]}, "one_state")):
        with pytest.raises(Refusal) as e:
            validate({**ok, **change})
        assert e.value.code == code
    assert Limits.from_env({"MAX_ROWS": "7"}).max_rows == 7


def test_index_cache():
    now = [0.0]
    c = IndexCache(2, 5, 10, lambda: now[0])
    c.put("a", 1, 2), c.put("b", 2, 2), c.get("a"), c.put("c", 3, 2)
    assert c.get("b") is None and c.get("a") == 1 and c.get("c") == 3
    c.put("big", 4, 6)
    assert c.get("big") is None
    now[0] = 11
    assert c.get("a") is None


def test_files(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"labels": ["x", "y"], "rows": [{"text": "t", "label": 1}]}')
    assert [tuple(r) for r in files.read_labelled_json(spark, str(tmp_path / "d.json")).collect()] == [(0, "t", "y")]
    cache = str(tmp_path / "cache")
    files.append_cache(spark.createDataFrame([("k", 1, "old")], "key string, seq int, answer string"), cache)
    files.append_cache(spark.createDataFrame([("k", 2, "new")], "key string, seq int, answer string"), cache)
    assert [r["answer"] for r in files.read_cache(spark, cache).collect()] == ["new"]
    sink = str(tmp_path / "sink")
    for rows in ([("a", 1)], [("a", 2), ("b", 3)]):
        files.append_new(spark.createDataFrame(rows, "id string, v int"), sink)
    assert sorted(tuple(r) for r in spark.read.schema("id string, v int").json(sink).collect()) == [("a", 1), ("b", 3)]


def test_more_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"question": {"type": "noul"}, "items": [{"id": "a", "state": {"documents": "x", "color": "red"}, "gold": true, "meta": {"depth_fraction": 0.5}}]}')
    r = files.read_tasks_json(spark, str(tmp_path / "t.json")).first()
    assert json.loads(r["state"]) == {"documents": "x", "color": "red"} and json.loads(r["meta"]) == {"depth_fraction": 0.5} and json.loads(r["question"]) == {"type": "noul"} and r["gold"]
    (tmp_path / "bare.json").write_text('{"question": "which", "items": [{"id": 1, "state": "s", "gold": false}]}')
    assert tuple(files.read_tasks_json(spark, str(tmp_path / "bare.json")).first()) == ("which", 1, "s", False, None)
    (tmp_path / "r.jsonl").write_text('{"id": "a", "p": 1}\n{"id": "b", "p": 2}\n{"p": 9}\n{"id": "a", "p": 3}\n')
    assert sorted(tuple(r) for r in files.read_results(spark, str(tmp_path / "r.jsonl"), "id string, p int").collect()) == [("a", 3), ("b", 2)]
    files.write_report(spark.createDataFrame([(1, 0.5)], "n int, auc double"), str(tmp_path / "report"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "report")).select("n", "auc").collect()] == [(1, 0.5)]
    rows = spark.createDataFrame([(i,) for i in range(20)], "id long")
    some = J.sample(rows, "id", 5, "s").collect()
    want = sorted(range(20), key=lambda i: hashlib.md5(f"s:{i}".encode()).hexdigest())[:5]
    assert [r["id"] for r in some] == want


def test_cache_probe(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, i int")
    cache = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 3, "x")], "key string, seq int, answer string")
    known, todo = S.probe(rows, cache)
    assert [(r["key"], r["answer"]) for r in known.collect()] == [("a", "new")] and [r["key"] for r in todo.collect()] == ["b"]
    assert Limits().clamped(512, 192) == 200 and Limits().clamped(150, 100) == 42 and Limits().clamped(10, 100) == 1


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "cat cat dog"), (2, "cat cat dog"), (3, None), (4, "dog")], "id int, text string")
    got = {r["id"]: list(r["v"]) for r in embedding.embedded(rows, embedding.LexicalEncoder(16)).collect()}
    counts = [0.0] * 16
    for t in ("cat", "cat", "dog"):
        counts[int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 16] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    assert got[1] == got[2] == pytest.approx([c / norm for c in counts]) and got[3] == [0.0] * 16
    asked = spark.sparkContext.accumulator(0)

    def factory():
        def model(texts):
            asked.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return model

    got = {r["id"]: list(r["v"]) for r in embedding.embedded(rows, embedding.ArrowEncoder(factory, "length", 2)).collect()}
    assert got == {1: [11.0, 1.0], 2: [11.0, 1.0], 3: [0.0, 1.0], 4: [3.0, 1.0]} and asked.value == 3


REQUEST = {
    "state": [{"text": "the cat sat\n\na dog barked\n\ncat cat"}],
    "questions": {"n": {"type": "noul", "instructions": "dog"}, "c": {"type": "choice", "instructions": "which", "criteria": {"cat": None, "dog": None}}, "s": {"type": "score", "instructions": "x", "criteria": ["no", "a cat"]}},
}


def test_service(spark):
    service = Service(spark, Limits(max_scan=3, max_rows=15))
    got = service.answer({**REQUEST, "detail": True})
    again = service.answer({**REQUEST, "strategy": "locate", "top_k": 2})
    assert not got["timing"]["cached"] and again["timing"]["cached"] and got["n_chunks"] == again["n_chunks"] == 3 and got["usage"]["document_tokens"] == 8
    answers = got["answers"]
    assert list(answers) == ["n", "c", "s"] and answers["n"]["noul"] == 0.5 and answers["c"]["choice"] == "cat" and answers["s"]["legend"] == ["no", "a cat"]
    assert [c["index"] for c in answers["c"]["chunks"]] == [0, 1, 2] and answers["n"]["chunks"][0]["gate"] == 1.0 and "chunks" not in again["answers"]["n"]
    assert sum(answers["c"]["probabilities"].values()) == pytest.approx(1) and again["answers"]["c"]["n_scored"] == 2 and json.dumps(got)
    four = {**REQUEST, "state": [{"text": "a\n\nb\n\nc\n\nd"}]}
    for body, code in ((four, "too_many_passages"), ({**four, "strategy": "locate", "top_k": 4}, "too_many_rows")):
        with pytest.raises(Refusal) as e:
            service.answer(body)
        assert (e.value.status, e.value.code) == (422, code)
    det = {**REQUEST, "detectors": {"n": [{"type": "choice", "instructions": "what", "criteria": {"cat": None, "dog": None}}, "dog"]}}
    assert service.answer(det)["answers"]["n"]["noul"] == pytest.approx(2 / 3, abs=1e-6)
    held = next(iter(service.cache.held.values()))[2]
    assert held.chunks.storageLevel.useMemory
    for i in range(service.limits.cache_items):
        service.cache.put(str(i), None, 0)
    assert not held.chunks.storageLevel.useMemory  # closed as it left

    def broken():
        def model(texts, q):
            raise RuntimeError("out of memory")

        return model

    with pytest.raises(Refusal) as e:
        Service(spark, scorer=S.ArrowScorer(broken)).answer(REQUEST)
    assert e.value.status == 503
    with pytest.raises(Refusal) as e:
        Service(spark, scorer=S.ArrowScorer(broken, max_options=1)).answer(REQUEST)
    assert (e.value.status, e.value.code) == (422, "invalid_request")
    assert plain({"a": [float("nan"), 1.5, (float("inf"), "x")], 1: None}) == {"a": [None, 1.5, [None, "x"]], "1": None}
    assert index_key("a", "m") != index_key("a", "n")


def test_stream(spark, tmp_path):
    from askwell.streaming.asking import ask_stream

    spark.createDataFrame([(1, "a dog")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    ask_stream(stream, Engine(), [NOUL], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
