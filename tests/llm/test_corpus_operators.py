"""Operators across documents, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
import zstandard

from askwell.llm import fingerprints, packing, repeats, similar, simhash
from askwell.llm.collection import collection_lcp
from askwell.llm.components import connected_components

tokenizers = pytest.importorskip("tokenizers")


def test_components(spark):
    random.seed(0)
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(50)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5), (None, 3)]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = set()
    for a, b in edges:
        if a is not None and a != b:
            nodes |= {a, b}
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_words_within_two_bits_share_an_index():
    one = [1 << i for i in range(23)]
    words = np.arange(2048)
    index, counts = simhash.golay_indices(words)
    for error in [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])]:
        other, others = simhash.golay_indices(words ^ error)
        assert ((index[:, :, None] == other[:, None, :]) & counts[:, :, None] & others[:, None, :]).any((1, 2)).all()


def slow_simhash(text, k=3):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))


def test_simhash_texts():
    for t in ("", "a", "a b", "A b c D", "x " * 50 + "y Z", "Éa b c d e\x1cf g\x0bh"):
        assert simhash.simhash(t) == slow_simhash(t)


@pytest.mark.parametrize("group", (4096, 3, 1))
def test_simhash_links(spark, group):
    rng = np.random.default_rng(0)
    points = set()
    for base in rng.integers(0, 2**63, size=3).tolist():
        for _ in range(150):
            base ^= 1 << int(rng.integers(0, 63))
            points |= {base, base ^ 1 << int(rng.integers(0, 63))}
    points = sorted(points)
    want = {(i, j) for i in range(len(points)) for j in range(i) if (points[i] ^ points[j]).bit_count() <= 2}
    found = simhash.fingerprint_links(spark.createDataFrame([(p, i) for i, p in enumerate(points)], "fp long, rep long"), 2, group)
    assert {(r["a"], r["b"]) for r in found.collect()} == want


def test_simhash_of_odd_tables(spark):
    random.seed(3)
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in range(3000)]
    long = " ".join(random.choices(words, k=60_000))
    rows = [(1, long), (2, long), (3, long + " one"), (3, long + " one"), (4, "q w e r t"), (None, "q w e r t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as fp", "3 as rep", "4 as component", "5 as free")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]
    assert all(r["fp"] % (1 << 64) == slow_simhash(long) for r in got if r["doc_id"] in (1, 2))


def test_simhash_groups(spark):
    docs = spark.createDataFrame([(5, None), (3, ""), (9, "a b c d"), (8, "a b c d"), (7, "q w e r")], "doc_id long, text string").selectExpr("*", "1 as fp", "2 as rep")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {5: 3, 3: 3, 9: 8, 8: 8, 7: 7}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    random.seed(3)
    lines = ["line %d of it. And more! " % i for i in range(30)]
    rows = [(i, "\n".join(random.choices(lines, k=random.randint(0, 60)))) for i in range(60)] + [(70, None), (71, "x" * 900), (71, "x" * 900)]
    docs = spark.createDataFrame(random.sample(rows, len(rows)), "doc_id long, text string")
    got = sorted(fingerprints.compared_with_edits(docs).collect())
    rows = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (r, (i, t)) in enumerate(zip(got, rows, strict=True)):
        u = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        if i != 71:  # their texts are equal, so either may come first
            assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
            for other, near in ((edited, r["near_edited"]), (u, r["near_next"])):
                a, b = Counter(fingerprints.paragraphs(t)), Counter(fingerprints.paragraphs(other))
                n = sum(a.values()) + sum(b.values())
                assert near == pytest.approx(2 * sum((a & b).values()) / n if n else 1.0)
    assert fingerprints.compared_with_edits(docs.limit(0)).count() == 0


def test_fingerprints_of_odd_tables(spark):
    """Repeated and null ids, very long texts, clashing names: rows in order of ids, each followed by the next one's text."""
    random.seed(2)
    long = "".join(f"line {i} of a very long text, which has many of them.\n" for i in range(8000))
    rows = [(None, "first"), (1, long), (2, long[: len(long) // 2] + "changed\n" + long[len(long) // 2 :]), (3, ""), (3, ""), (4, None), (5, "last\nline")]
    docs = spark.createDataFrame(random.sample(rows, len(rows)), "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as extra", "3 as z", "4 as fingerprint")
    got = sorted(fingerprints.compared_with_edits(docs).collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 4, 5]
    for r, (i, t), (_, u) in zip(got, rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
    assert got[1]["near_next"] > 0.99 and got[3]["near_next"] == got[4]["near_next"] == 1.0 and got[3]["fingerprint"] == got[5]["fingerprint"]


def test_sketches_recover_the_difference():
    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 2**63, n).astype("u8")) for n in (0, 1, 5, 400)]
    b = [np.append(x[: len(x) // 2], rng.integers(0, 2**63, 3).astype("u8")) for x in a]
    for x, y, (only_x, only_y) in zip(a, b, fingerprints.differences(a, b), strict=True):
        assert set(only_x) == set(x) - set(y) and set(only_y) == set(y) - set(x)
    s = fingerprints.sketched(a)
    back = fingerprints.unpacked(s.packed())
    assert (back.sum == s.sum).all() and (back.count == s.count).all() and (back.check == s.check).all()


@pytest.mark.parametrize("block", (1, 3, 1 << 20))
def test_collection(block):
    random.seed(block)
    for _ in range(60):
        letters = random.choice([b"ab", b"abc", b"abcdefgh\x00\xff"])
        strings = [bytes(random.choices(letters, k=random.randint(0, 12))) for _ in range(random.randint(1, 10))]
        strings += random.choices(strings, k=2)
        owner, length, lcp = collection_lcp(np.frombuffer(b"".join(strings), "u1"), np.array([*map(len, strings)]), block)
        got = [strings[i][len(strings[i]) - n :] for i, n in zip(owner.tolist(), length.tolist(), strict=True)]
        assert got == sorted(s[k:] for s in strings for k in range(len(s) + 1))
        common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert lcp.tolist() == [0, *(common(x, y) for x, y in zip(got, got[1:], strict=False))]


def brute_repeats(rows):
    rows = [(2**63 - 1 if d is None else d, d, (t or "").encode()) for d, t in rows]
    first = defaultdict(lambda: 2**63)
    for key, _, b in rows:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first[b[p : p + 50]], key)
    out = []
    for key, d, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out.append((d, len(b), sum(gone), sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ({}, {"wide": 1, "collection": 10}, {"part_bytes": 4000, "slice_bytes": 700}))
def test_repeats(spark, how):
    random.seed(0)
    base = ["".join(random.choices("ab \né", k=random.randint(0, 300))) for _ in range(12)]
    rows = [(i, random.choice(base)[random.randint(0, 30) :] + random.choice(base)) for i in range(100)]
    rows += [(None, base[0] * 2), (3, base[1] * 2), (3, base[1] * 2), (500, None), (501, ""), (7, "x" * 500), (8, "x" * 70), (9, "xy" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sha", "2 as part")
    assert sorted((tuple(r) for r in repeats.repeated_passages(docs, **how).collect()), key=str) == brute_repeats(rows)


def test_repeats_across_blocks_slices_and_parts():
    """Texts longer than a block and a slice, cut into pieces as a window-by-window loop cuts them."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 101, n).astype("u1") for n in (50, 49, 3, 200_000, 60, 131_100)] + [np.full(70_000, 120, "u1"), np.zeros(0, "u1")]
    data, lengths = np.concatenate(texts), np.array([*map(len, texts)])
    p = repeats.Pieces(data, lengths)
    windows = [s + k for s, n in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist(), strict=True) for k in range(n - 49)]
    assert np.repeat(p.start, p.windows).tolist() == [a for a, n in zip(p.start.tolist(), p.windows.tolist(), strict=True) for _ in range(n)]
    assert repeats._ranges(p.start, p.windows).tolist() == windows and p.windows.max() <= 35 and (p.place < 35).all()
    # Equal bytes round the anchor give equal hashes, wherever in the block they stand.
    assert (p.anchor == repeats._mix(np.array([_anchor_hash(data[a : a + 16]) for a in (p.start + p.place).tolist()], "u8"))).all()
    first = p.first_equal()
    raw = data.tobytes()
    pieces = [raw[s : s + n + 49] for s, n in zip(p.start.tolist(), p.windows.tolist(), strict=True)]
    seen = {}
    assert first.tolist() == [seen.setdefault(x, k) for k, x in enumerate(pieces)]


def test_repeats_of_one_anchor(spark):
    """A passage that is in every document, each time with other bytes round it: its anchor's pieces are dealt by the piece and compared by windows."""
    random.seed(11)
    fill = lambda n: "".join(random.choices("qwrtzpsdfghjk", k=n))
    low = min((fill(16) for _ in range(3000)), key=lambda t: _anchor_hash(t.encode()))  # the anchor of all windows that have it
    rows = [(i, fill(30) + low + fill(30)) for i in range(300)]
    rows += [(300 + i, fill(5) + rows[i][1] + fill(5)) for i in range(0, 300, 3)]
    docs = spark.createDataFrame(random.sample(rows, len(rows)), "doc_id long, text string")
    plan = repeats.Repeats(docs, wide=100, part_bytes=8000)
    assert len(plan.wide_anchors.value) >= 1 and plan.shared.where("kind = 2").count() > 0
    plan.close()
    for how in ({"wide": 100, "part_bytes": 8000}, {}):
        assert sorted((tuple(r) for r in repeats.repeated_passages(docs, **how).collect()), key=str) == brute_repeats(rows)


def _anchor_hash(data):
    h = sum((int(b) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(data)) % (1 << 64)
    return (h ^ h >> 32) * 0xBF58476D1CE4E5B9 % (1 << 64)


def test_repeats_in_long_texts(spark):
    random.seed(8)
    words = ["".join(random.choices("abcdefgh", k=5)) for _ in range(400)]
    long = [" ".join(random.choices(words, k=40_000)) for _ in range(3)]
    rows = [(1, long[0]), (2, long[1] + long[0][100_000:100_300]), (3, long[2][:70_000] + long[1][10:90_000] + long[2][70_000:]), (4, long[2]), (5, long[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in repeats.repeated_passages(docs, slice_bytes=100_000, part_bytes=300_000).collect()), key=str) == brute_repeats(rows)


def test_repeats_send_a_blob_a_bucket_whatever_the_slices(spark):
    """Slices of a part go to a bucket together, up to a bound; what is compared doesn't depend on the bounds."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice([*"abcdefgh"], 5)) for _ in range(30)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    texts += [texts[k][20:200] + texts[k + 1][:150] for k in range(30)]

    def opened(per):
        base = 0
        for at in range(0, len(texts), per):
            some = [t.encode() for t in texts[at : at + per]]
            row = {"z": zstandard.compress(b"".join(some)), "lengths": repeats._pack(np.array([*map(len, some)], "u4")), "ids": repeats._pack(np.arange(at, at + len(some)))}
            yield repeats.Slice(row, base)
            base += len(repeats.Pieces(np.frombuffer(b"".join(some), "u1"), np.array([*map(len, some)])).start)

    def bits(rows, most):
        buckets = {b: [(p, z) for c, p, z in rows if c == b] for b, *_ in rows}
        told = [repeats._unpack(z) for blobs in buckets.values() for _, _, z in repeats.compare_pieces(blobs, 50, most)]
        return sorted((o, m) for t in told for o, m in zip(*map(list, t), strict=True))

    asked = {1: np.arange(sum(len(s.pieces.start) for s in opened(7))), 2: np.zeros(0, "i8")}
    rows = repeats.send_pieces(opened(7), 0, asked, 5)
    assert len(rows) == 5 and len(repeats.send_pieces(opened(7), 0, asked, 5, 1)) > 40
    assert bits(rows, 1 << 30) == bits(rows, 2000) == bits(repeats.send_pieces(opened(7), 0, asked, 5, 1), 2000) != []


def test_parts_of_large_tables():
    """Blobs go with the square of the parts: at 10 GB of text (a table of 6 GB) there are some 600 parts and no task opens over 16 MB."""
    for size, parts in ((850 << 20, 213), (10_000 << 20, 625)):
        assert -(-size // repeats.part_size(size)) == parts and repeats.part_size(size) <= 1 << 24


def test_without_repeats(spark):
    p = "the same passage of more than fifty bytes stands in both of them, word for word"
    docs = spark.createDataFrame([(1, p + " one", "a", 0), (2, "two " + p, "b", 0), (3, "short", "c", 0), (4, p + " one", "d", 0)], "doc_id long, text string, source string, n_chars int")
    got = {r["doc_id"]: r for r in repeats.without_repeats(docs).collect()}
    assert got[1]["text"] == p + " one" and got[2]["text"] == "two " and got[3]["text"] == "short" and got[4]["text"] == ""
    assert got[2]["n_chars"] == 4 and got[2]["source"] == "b"
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_similar_groups(spark):
    random.seed(4)
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows, want = [], {}
    for g in range(30):
        base = random.choices(words, k=300)
        for c in range(1 + g % 4):
            copy = list(base)
            for k in random.sample(range(300), c):
                copy[k] = random.choice(words)
            want[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1])]
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, g in want.items():
        first.setdefault(g, i)
    assert {i: found.get(i, i) for i in want} == {i: first[g] for i, g in want.items()}
    assert found[1001] == 1000
    assert similar.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).count() == 30 + 1 + 1


def test_similar_groups_of_odd_tables(spark):
    random.seed(5)
    base = ["".join(random.choices("abcdefgh", k=6)) for _ in range(300)]
    rows = [(9, " ".join(base)), (4, " ".join(base)), (4, " ".join(base)), (7, " ".join(base[:290])), (2, "short text"), (3, "short text"), (5, "Short TEXT"), (6, "short texts"), (None, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as n", "3 as bits", "4 as fp", "5 as a", "6 as __x")
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs).collect()}
    assert found == {9: 4, 4: 4, 7: 4, 2: 2, 3: 2, 5: 2}
    kept = similar.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "4", "4", "6", "None"]
    assert similar.similar_groups(docs.limit(0)).count() == 0 and similar.one_of_each_group(docs.limit(0)).count() == 0


def test_layout():
    random.seed(6)
    for trial in range(40):
        totals = {f"s{i}": random.choice([1, 5, random.randint(1, 300), random.randint(1, 20000)]) for i in range(random.randint(1, packing.QUEUES))}
        targets = {q: random.random() for q in totals} if trial % 2 else None
        plan, windows = packing.Layout(totals, targets), defaultdict(list)
        for q, n in totals.items():
            x = 0
            while x < n:
                m, got = min(n - x, random.randint(1, 700)), 0
                for w, o, k in plan.pieces(q, x, m):
                    windows[w].append((o, k, q))
                    got += k
                assert got == m
                x += m
        assert sorted(windows) == list(range(len(windows)))
        for w, pieces in windows.items():
            at = 0
            for o, k, _ in sorted(pieces):
                assert o == at
                at += k
            assert at == packing.WINDOW or at & (at - 1) == 0
        if targets is None:
            total = sum(totals.values())
            for w in range(total // packing.WINDOW - 1):
                have = Counter()
                for _, k, q in windows[w]:
                    have[q] += k
                small = [q for q in totals if q != max(totals, key=lambda q: (totals[q], q))]
                assert all(abs(have[q] - packing.WINDOW * totals[q] / total) < 1 for q in small)


def test_layout_is_a_deficit_round_robin():
    """Counters run step by step: a quantum each, the whole part into the window, the rest carried."""
    random.seed(9)
    for _ in range(20):
        totals = {f"s{i}": random.randint(1, 30_000) for i in range(random.randint(2, 20))}
        mix, total = packing.Mixture(totals), sum(totals.values())
        queues = sorted(totals, key=lambda q: (totals[q], q))
        deficit, taken = dict.fromkeys(queues, Fraction(0)), dict.fromkeys(queues, 0)
        for w in range(mix.last):
            room = packing.WINDOW
            for q in queues[:-1]:
                deficit[q] += Fraction(packing.WINDOW * totals[q], total)
                n = int(deficit[q])
                deficit[q] -= n
                taken[q] += n
                room -= n
            taken[queues[-1]] += room
            assert mix.taken(w + 1) == [taken[q] for q in queues]
            assert all(0 <= d < 1 for d in deficit.values())


def test_packing(spark):
    docs = spark.createDataFrame([(1, "a b c " * 900, "x"), (2, None, None), (3, "", "y"), (4, "z " * 5000, "y"), (4, "z " * 5000, "y"), (5, "a", "")], "doc_id long, text string, source string").selectExpr("*", "1 as queue")
    rows = packing.pack_documents(docs, with_ids=True).collect()
    library = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    windows, got = defaultdict(dict), defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]][r["offset"]] = r["length"]
        assert len(r["ids"]) == 4 * r["length"] and r["ids_crc32"] == zlib.crc32(r["ids"])
        got[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for pieces in windows.values():
        at = 0
        for o in sorted(pieces):
            assert o == at
            at += pieces[o]
        assert at == 4096 or at & (at - 1) == 0
    ids = {t: [*library.encode(t, add_special_tokens=False).ids, 2] for t in ("a b c " * 900, "", "z " * 5000, "a")}
    for d, t, copies in ((1, "a b c " * 900, 1), (2, "", 1), (3, "", 1), (4, "z " * 5000, 2), (5, "a", 1)):
        pieces = got[d, len(ids[t])]
        # Each id is in one piece, at its place; a repeated row is there twice.
        assert sorted(s + k for s, x in pieces for k in range(len(x))) == sorted([*range(len(ids[t]))] * copies)
        assert all(x == ids[t][s : s + len(x)] for s, x in pieces)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    queues = {r["queue"] for r in packing.tokenised(docs, packing.default_vocabulary()).select("queue").collect()}
    assert queues == {packing.queue_of(q) for q in ("x", "y", "", None)} and len(queues) == 4


@pytest.mark.parametrize("named", (False, True))
@pytest.mark.parametrize("sizes", ([900] * 100, [20_000] + [40] * 300 + [1] * 50, [3] * 9000, [70_000, 1, 5] + [*range(1, 200)]))
def test_layout_of_many_sources(sizes, named):
    totals = {f"s{i}": n for i, n in enumerate(sizes)}
    if named and len(sizes) > 400:
        pytest.skip("one phase a source")
    targets = {q: 1 / (1 + i % 3) for i, q in enumerate(totals)} if named else None
    plan, windows = packing.Layout(totals, targets), defaultdict(list)
    for q, n in totals.items():
        x = 0
        while x < n:
            m = min(n - x, 611)
            got = [*plan.pieces(q, x, m)]
            assert sum(k for *_, k in got) == m
            for w, o, k in got:
                windows[w].append((o, k, q))
            x += m
    assert sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        at = 0
        for o, k, _ in sorted(pieces):
            assert o == at
            at += k
        assert at == packing.WINDOW or at & (at - 1) == 0
    total, have = sum(sizes), Counter()
    for w in range(total // packing.WINDOW - 1 if targets is None else 0):
        for _, k, q in windows[w]:
            have[q] += k
        for q, n in totals.items():
            if n * packing.WINDOW >= total:
                assert abs(have[q] - (w + 1) * packing.WINDOW * n / total) <= 1
    if targets and sizes == [900] * 100:
        for _, k, q in windows[0]:
            have[q] += k
        assert have["s0"] > 1.8 * have["s1"] > 0 and have["s1"] > 1.3 * have["s2"] > 0


def test_packing_keeps_each_source(spark):
    docs = spark.createDataFrame([(i, "z " * 400, f"s{i % 80}") for i in range(320)], "doc_id long, text string, source string")
    rows = packing.pack_documents(docs, targets={f"s{i}": 3.0 if i < 20 else 1.0 for i in range(80)}).collect()
    first = Counter()
    for r in rows:
        if r["sequence_id"] < 5:
            first[r["doc_id"] % 80 < 20] += r["length"]
    assert sum(r["length"] for r in rows) == 320 * 401 and abs(first[True] / sum(first.values()) - 0.5) < 0.02
