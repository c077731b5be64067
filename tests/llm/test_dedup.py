"""Exact, line and near deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import exact_dedup, line_dedup, near_dedup
from tests.llm.conftest import ODD


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(odd, keep):
    groups = defaultdict(list)
    for doc_id, text, *_ in ODD:
        groups[text or ""].append(doc_id)
    want = []
    for doc_id, text, *_ in ODD:
        ids = [i for i in groups[text or ""] if i is not None]
        best = (min if keep == "min" else max)(ids) if ids else None
        want.append((doc_id, best, len(groups[text or ""]), doc_id == best, sha(text)))
    got = [tuple(r)[:5] for r in exact_dedup.exact_groups(odd, keep).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_drop_copies(odd, empty):
    left = exact_dedup.drop_copies(odd, "max")
    assert left.columns == odd.columns
    assert sorted(str(r[0]) for r in left.collect()) == sorted(map(str, [2, 3, 5, 6, 7, 8, 9, None, 2**62 + 1]))
    assert exact_dedup.drop_copies(empty).count() == exact_dedup.exact_groups(empty).count() == 0
    with pytest.raises(ValueError, match="missing"):
        exact_dedup.exact_groups(odd.select("doc_id"))


def test_one_row_of_repeated_ones_stays(spark):
    rows = [(1, "same", "b"), (1, "same", "a"), (1, "same", "a"), (2, "other", "x"), (2, "other", "x"), (1, "third", "c"), (None, "lost", "q"), (None, "lost", "p"), (3, "same", "z"), (None, None, None), (None, "", "e")]
    table = spark.createDataFrame(rows, "doc_id long, text string, m string").withColumn("more", F.create_map(F.lit("k"), F.col("m")))
    for drop in (exact_dedup.drop_copies, near_dedup.drop_near_copies):
        one, two = (sorted((str(r.doc_id), r.text or "", r.m or "") for r in drop(t).collect()) for t in (table, table.repartition(5)))
        assert one == two and [r[:2] for r in one] == [("1", "same"), ("1", "third"), ("2", "other"), ("None", ""), ("None", "lost")]
    only = spark.createDataFrame([(4, "x y")] * 50, "doc_id long, text string")
    assert exact_dedup.drop_copies(only).collect() == near_dedup.drop_near_copies(only).collect() == [(4, "x y")]


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    held = defaultdict(list)
    for place, (doc_id, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(place)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            k = key(line)
            ids = {rows[p][0] for p in held[k]}
            top = max((i for i in ids if i is not None), default=None)
            if len(k) < 20 or len(ids) < 3 or doc_id == top:
                keep.append(line)
        out.append((doc_id, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def test_lines(odd, docs, empty):
    for table, rows in ((odd, [r[:2] for r in ODD]), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(table).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute_lines(rows)))
    assert line_dedup.dedup_lines(empty).count() == 0
    few = sorted(map(repr, line_dedup.dedup_lines(docs, salts=1).collect()))
    assert few == sorted(map(repr, line_dedup.dedup_lines(docs, salts=50).collect()))
    got = {r.doc_id: r.keep_bitmap for r in line_dedup.dedup_lines(odd).collect()}
    assert got[3] == got[1] == [] and [tuple(x) for x in got[9]] == [(0, 2)]


def test_a_line_of_all_documents(spark):
    rows = [(k * 7919 % 10_007, f"one line that every document has\nown line number {k} of this document\none line that EVERY document has ") for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = line_dedup.dropped_lines(table, salts=16)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_lines(rows))) and dropped.count() == 599
    # the lines move once: the second use of the dealt lines reads the same exchange
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    dropped = line_dedup.dropped_lines(table)
    dropped.collect()
    text = dropped._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in text
    # one id on several rows is one document; two documents don't make a line common
    rows = [(1, "a line of two documents only"), (1, "a line of two documents only\nx"), (2, "a line of two documents only"), (None, "a line of no id, thrice over"), (None, "a line of no id, thrice over\ny"), (None, "a line of no id, thrice over\nz")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(table).collect()} == {0}


def brute_classes(rows, threshold=0.8):
    sets = [near_dedup.shingles(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or near_dedup.similarity(sets[a], sets[b]) >= threshold:
                parent[root(a)] = root(b)
    best = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[root(k)] = min(doc_id, best.get(root(k), doc_id))
    return [(doc_id, best.get(root(k))) for k, (doc_id, _) in enumerate(rows)]


def test_near_classes(odd, docs, empty):
    got = [(r.doc_id, r.class_id) for r in near_dedup.near_classes(docs).collect()]
    assert sorted(got) == sorted(brute_classes([(r.doc_id, r.text) for r in docs.collect()]))
    rows = [r[:2] for r in ODD]
    got = [(r.doc_id, r.class_id) for r in near_dedup.near_classes(odd).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_classes(rows)))
    assert near_dedup.near_classes(empty).count() == 0
    left = near_dedup.drop_near_copies(odd)
    assert left.columns == odd.columns and 2 not in [r[0] for r in left.collect()]


def test_chains_of_near_copies(spark):
    words = [f"w{k}" for k in range(200)]
    chain, rows = list(words), []
    for k in range(12):
        chain[k * 15] = f"new{k}"  # each is near the one before, the last far from the first
        rows.append((100 - k, " ".join(chain)))
    rows += [(500, " ".join(words[::-1])), (501, "other text altogether here now")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(table).collect()}
    assert got == dict(brute_classes(rows)) and got[100] == got[89] == 89 and got[500] == 500


def test_copies_that_are_near_to_their_source_alone(spark):
    draw = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(120):
        copy = list(base)
        for at in draw.sample(range(0, 300, 6), 5):
            copy[at] = f"c{k}x{at}"
        rows.append((k + 1000 * (k >= 60), " ".join(copy)))
    rows.append((500, " ".join(base)))  # its id is neither the smallest nor the largest
    sets = [near_dedup.shingles(t) for _, t in rows]
    assert all(near_dedup.similarity(s, sets[-1]) > 0.8 for s in sets[:-1])
    assert np.mean([near_dedup.similarity(sets[0], s) >= 0.8 for s in sets[1:-1]]) < 0.1
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(table).collect()}
    assert set(got.values()) == {0} and len(got) == 121


def boilerplate(pairs, alone, words=300, own=44, shared=10):
    """Texts with one passage in common, none near to another but each with its partner; partners have neighbouring places."""
    passage = [f"p{k}" for k in range(words)]
    rows = []
    for k in range(alone + 2 * pairs):
        mine = [f"o{k}x{j}" for j in range(own)]
        if k >= alone and (k - alone) % 2:
            mine = [f"o{k - 1}x{j}" for j in range(shared)] + [f"q{k}x{j}" for j in range(own - shared)]
        rows.append((k * 7919 % 100_003, " ".join(passage + mine)))
    return rows


@pytest.mark.parametrize("block", [1024, 50])
def test_pairs_inside_a_boilerplate_family(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    rows = boilerplate(60, 80)
    want = brute_classes(rows)
    assert len({c for _, c in want}) == 140
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.near_classes(table).collect()) == sorted(want)


def test_copies_of_a_source_that_is_absent(spark):
    draw = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(200):
        copy = list(base)
        for at in draw.sample(range(0, 300, 6), 4):
            copy[at] = f"c{k}x{at}"
        rows.append((k * 7919 % 100_003, " ".join(copy)))
    bands = near_dedup.band_hashes(near_dedup.signatures([near_dedup.shingles(t) for _, t in rows]))
    want = brute_classes(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(table).collect()}
    # every link whose texts share a band is in one class, and no class joins what isn't linked
    sets = [near_dedup.shingles(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if (bands[a] == bands[b]).any() and near_dedup.similarity(sets[a], sets[b]) >= 0.8:
                assert got[rows[a][0]] == got[rows[b][0]]
    best = dict(want)
    assert all(best[i] == best[c] for i, c in got.items())


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}


def test_similarity_and_estimate():
    def plain(a, b):
        wa, wb = (dict(zip(s[0].tolist(), near_dedup.weights(s[1]), strict=True)) for s in (a, b))
        every = set(wa) | set(wb)
        shared = set(wa) & set(wb)
        jp = sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in every) for d in shared)
        return jp, len(shared) / len(every)

    base = [f"w{k % 70}" for k in range(160)]
    misses = []
    for step in (3, 7, 20, 50):
        other = [w if k % step else f"x{k}" for k, w in enumerate(base)] + base[:30]
        a, b = near_dedup.shingles(" ".join(base)), near_dedup.shingles(" ".join(other))
        jp, jaccard = plain(a, b)
        assert near_dedup.similarity(a, b) == pytest.approx(max(jp, jaccard))
        one, two = near_dedup.signatures([a, b], 4096)
        misses.append((one == two).mean() - jp)
        alone = near_dedup.signatures([a], 4096)[0]
        assert (alone == one).all()  # a signature doesn't depend on what shares its pass
    assert np.abs(misses).max() < 0.035


def test_shingles():
    assert len(near_dedup.shingles("")[0]) == len(near_dedup.shingles(" .\n")[0]) == 0
    assert len(near_dedup.shingles("one two")[0]) == 1
    a, b = near_dedup.shingles("Some, words: of (this) TEXT here"), near_dedup.shingles("some words of this text here")
    assert (a[0] == b[0]).all() and len(a[0]) == 2
    long = "lorem ipsum dolor sit amet " * 40_000
    hashes, counts = near_dedup.shingles(long)
    assert len(hashes) == 5 and counts.sum() == 200_000 - 4


def test_links_by_plain_similarity_of_texts_that_repeat_themselves(spark):
    """Shared passages that one text repeats lower the probability Jaccard, not the plain one, which makes the link."""
    rows = []
    for k in range(40):
        shared = [f"s{k}x{j}" for j in range(204)]
        own = [f"a{k}x{j}" for j in range(16)]
        other = [f"b{k}x{j}" for j in range(16)]
        rows.append((2 * k, " ".join(shared + own)))
        rows.append((2 * k + 1, " ".join(shared + other + shared[:64] * 50)))
    sets = [near_dedup.shingles(t) for _, t in rows]
    plain = [len(np.intersect1d(a[0], b[0])) / len(np.union1d(a[0], b[0])) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert min(plain) >= 0.8
    weighted = near_dedup.band_hashes(near_dedup.signatures(sets))
    missed = sum(not (a == b).any() for a, b in zip(weighted[::2], weighted[1::2], strict=True))
    bands = near_dedup.all_bands(sets)
    assert missed > 0 and all(len(np.intersect1d(a, b)) for a, b in zip(bands[::2], bands[1::2], strict=True))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(80)}


def test_texts_of_one_id_and_of_no_id_are_nodes_of_their_own(spark):
    base = [f"w{k}" for k in range(120)]
    near = [*base[:-1], "end"]
    other = [f"o{k}" for k in range(120)]
    rows = [(1, " ".join(base)), (1, " ".join(other)), (2, " ".join(near)), (None, " ".join(other[:-1])), (None, "alone here with no id at all"), (None, "alone here with no id at all")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in near_dedup.near_classes(table).collect())
    assert got == [("1", "1", 2, True), ("1", "1", 2, True), ("2", "1", 2, False), ("None", "1", 2, False), ("None", "None", 2, True), ("None", "None", 2, True)]
    left = sorted((str(r.doc_id), r.text[:5]) for r in near_dedup.drop_near_copies(table).collect())
    assert left == [("1", "o0 o1"), ("1", "w0 w1"), ("None", "alone")]


def test_recall_by_similarity(spark):
    """Copies with random edits of words, by the plain similarity of word 5-shingles, held against all that is 0.8 or more."""
    draw, rows, pairs = random.Random(12), [], []
    for k in range(400):
        base = [f"v{draw.randrange(4000)}" for _ in range(draw.randint(60, 400))]
        copy = list(base)
        for _ in range(draw.randint(1, max(1, len(base) // 40))):
            at = draw.randrange(len(copy))
            if draw.random() < 0.5:
                copy[at] = f"e{draw.randrange(10**9)}"
            else:
                del copy[at]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = (near_dedup.shingles(t)[0] for _, t in rows[-2:])
        pairs.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = np.array([got[2 * k + 1] == 2 * k for k in range(400)])
    pairs = np.array(pairs)
    lower = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), 0.5, 64).collect()}
    assert all(lower[2 * k + 1] == 2 * k for k in range(400) if pairs[k] >= 0.5)
    assert (pairs >= 0.8).sum() > 100 and found[pairs >= 0.8].all() and not found[pairs < 0.75].any()
