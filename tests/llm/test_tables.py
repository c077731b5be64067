"""Token tables, packing, mixing and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from keyloom.llm import mixing, packing, token_table
from keyloom.llm.common import pick
from tests.llm.conftest import ODD, SF
from tests.llm.test_dedup import brute_classes


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_table.vocabulary_path())


def test_encoder_equals_the_library(tokenizer, texts):
    encode = token_table.WordEncoder(token_table.vocabulary_path(), limit=50)
    odd = ["", " ", "a  b", "\n\n a", " lead", "trail ", "don't  stop\tit's 123abc ½³ 漢字 é\u0085x  y\x1cz", "<|endoftext|> hi", "a\r\nb", "\U0001f389\U0001f389 ok​z", "x　y", "a\nb c\nd"]
    draw = random.Random(2)
    odd += ["".join(draw.choice(" \n\t'aB1.é漢  s") for _ in range(40)) for _ in range(300)]
    for text in [*odd, *list(texts.values())[:60]]:
        assert np.frombuffer(encode(text), encode.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_vocabulary_with_other_steps(texts):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    loaded, encode = Tokenizer.from_file(path), token_table.WordEncoder(path)
    assert not encode.by_word
    for text in ["Don't STOP  it's", "a <|endoftext|> b", "", *list(texts.values())[:20]]:
        assert np.frombuffer(encode(text), encode.dtype).tolist() == loaded.encode(text, add_special_tokens=False).ids


def test_added_tokens_as_the_library_loads_them(spark):
    loaded = Tokenizer.from_file(token_table.vocabulary_path())
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "plain words"), (4, "a  <|endoftext|>\n\ud55c")]
    encode = token_table.encoder(token_table.vocabulary_path())
    want, start = [], 0
    for doc_id, text in rows:
        ids = loaded.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), encode.dtype).tolist() == ids
        want.append((doc_id, start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
        start += len(ids) + 1
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_table.read_tables(token_table.write_tables(table, token_table.vocabulary_path())).collect()
    assert sorted(map(tuple, got)) == want


def test_token_tables(odd, docs, empty, tokenizer):
    for table in (odd, docs):
        rows = [(r.doc_id, r.text or "") for r in pick(table, "doc_id", "text").collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want, start = [], 0
        for doc_id, text in rows:
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
            want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        manifest = token_table.write_tables(table, token_table.vocabulary_path())
        got = sorted((tuple(r) for r in token_table.read_tables(manifest).collect()), key=lambda r: r[1])
        assert got == want
        held = defaultdict(list)
        for doc_id, _, n, _ in want:
            held[doc_id].append(n)
        ranges = sorted(manifest.collect(), key=lambda m: bytes(m.first_key))
        for doc_id in [*list(held)[:40], -5, 10**9]:
            lengths = []
            for m in ranges:
                with token_table.TokenTable(m.path) as one:
                    lengths += [len(ids) for ids in one.get(doc_id)]
            assert lengths == held.get(doc_id, [])
    assert token_table.read_tables(token_table.write_tables(empty, token_table.vocabulary_path())).count() == 0


def test_strays_go(spark, docs, tmp_path):
    manifest = token_table.write_tables(docs, token_table.vocabulary_path(), folder=f"file://{tmp_path}")
    folder = manifest.first().path.rsplit("/", 1)[0]
    (tmp_path / folder.rsplit("/", 1)[-1] / "part-000000-failed.sst").write_bytes(b"x")
    assert token_table.remove_strays(manifest, folder) == 1 and token_table.remove_strays(manifest, folder) == 0
    assert token_table.read_tables(manifest).count() == docs.count()


def test_token_table_file(tmp_path):
    path = tmp_path / "one.sst"
    values = {k * 3: np.arange(k % 700, dtype="<u2") for k in range(3000)}
    with path.open("wb") as sink:
        writer = token_table.TableWriter(sink, 2)
        for doc_id, ids in values.items():
            writer.add(doc_id, 0, ids.tobytes())
        writer.close()
    with token_table.TokenTable(f"file://{path}") as table:
        assert len(table.index) > 3 and table.n_docs == 3000
        assert [i for i, _ in table] == list(values)
        assert all((table.get(i)[0] == values[i]).all() for i in list(values)[::97])
        absent = [i for i in range(9000) if i % 3]
        assert sum(table.may_hold(i) for i in absent) < 0.03 * len(absent) and table.get(4) == []
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(ValueError, match="no whole"):
        token_table.TokenTable(f"file://{path}")


def naive_best_fit(lengths, capacities, cost):
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    rooms, where = [], {}
    for place, k in enumerate(order):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= lengths[k]]
        if fits:
            room = min(fits)[0]
            b = max(b for r, b in fits if r == room)
            b = next(x for x in reversed(naive_best_fit.stack[room]) if rooms[x] == room)
        else:
            prices = []
            for c in sorted(capacities):
                if c >= lengths[k]:
                    rest = sum(lengths[j] for j in order[place + 1 :] if lengths[j] <= c - lengths[k])
                    prices.append((cost(c) / (lengths[k] + min(c - lengths[k], rest)), c))
            b = len(rooms)
            rooms.append(min(prices)[1])
        where[k] = b
        rooms[b] -= lengths[k]
        naive_best_fit.stack[rooms[b]].append(b)
    return [where[k] for k in range(len(lengths))]


@pytest.mark.parametrize("seed", range(8))
def test_best_fit(seed):
    draw = random.Random(seed)
    capacities, cost = (16, 40, 100), lambda c: c + c * c / 90 + 9
    lengths = [draw.choice([draw.randint(1, 12), draw.randint(1, 100)]) for _ in range(draw.randint(0, 80))]
    where, final = packing.best_fit(lengths, capacities, cost)
    naive_best_fit.stack = defaultdict(list)
    assert [b for b, _ in where] == naive_best_fit(lengths, capacities, cost)
    spans = defaultdict(list)
    for n, (b, at) in zip(lengths, where, strict=True):
        spans[b].append((at, at + n))
    for b, parts in spans.items():
        parts.sort()
        assert parts[0][0] == 0 and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        assert final[b] == min(c for c in capacities if c >= parts[-1][1])


def test_packing(odd, docs, empty):
    for table in (odd, docs):
        sizes = Counter()
        for r in pick(table, "doc_id", "text").collect():
            sizes[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))
        rows = packing.pack(table, shard_docs=50).collect()
        got, bins = Counter(), defaultdict(list)
        for r in rows:
            got[r.doc_id] += r.length
            if r.bin_id is not None:
                bins[r.bin_id].append((r.bin_offset, r.length, r.capacity))
        assert +got == +sizes and set(got) == set(sizes)
        for parts in bins.values():
            parts.sort()
            assert len({c for *_, c in parts}) == 1 and sum(n for _, n, _ in parts) <= parts[0][2]
            assert all(a + n == b for (a, n, _), (b, _, _) in zip(parts, parts[1:], strict=False))
        long = sorted((r.chunk, r.start, r.length) for r in rows if r.doc_id == 7 and table is odd)
        assert not long or long == [(0, 0, 8192), (1, 8192, 8192), (2, 16384, 8192), (3, 24576, 30001 - 24576)]
    assert packing.pack(empty).count() == 0
    again = [tuple(r) for r in packing.pack(docs, shard_docs=50).collect()]
    assert sorted(again, key=repr) == sorted(map(tuple, packing.pack(docs.repartition(3), shard_docs=50).collect()), key=repr)


def test_packing_of_one_row_repeated(spark):
    table = spark.range(3000).selectExpr("IF(id < 2500, NULL, id) AS doc_id", "'a b c' AS text")
    rows = packing.pack(table, shard_docs=300).collect()
    assert len(rows) == 3000 and sum(r.length for r in rows) == 9000
    shards = Counter(r.bin_id >> 32 for r in rows)
    assert len(shards) > 5 and max(shards.values()) < 1200
    assert len({(r.bin_id, r.bin_offset) for r in rows}) == 3000


def poured(sizes, weights, cap=3):
    """Targets by sharing and sharing again."""
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in full]
        left = total - sum(full.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return full | share
        full |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    draw = random.Random(seed)
    names = [*(f"s{k}" for k in range(draw.randint(1, 9))), None]
    sizes = {s: draw.choice([0, 1, 10, 1000, 50_000]) + draw.randint(1, 9) for s in names}
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate([*sorted(n for n in names if n), None])}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = poured(sizes, weights)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_targets_of_many_sources(spark):
    """Sizes that fill one after another; the plan brings no exchange of all sources to one task."""
    draw = random.Random(3)
    sizes = {f"s{k:04}": int(1.7 ** draw.uniform(0, 40)) for k in range(1500)} | {None: 10**9}
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate([*sorted(n for n in sizes if n), None])}
    found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"))
    got = {r.source: r.target for r in found.collect()}
    want = poured(sizes, weights)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    nothing = spark.createDataFrame([("a", 0), (None, 0)], "source string, size long")
    assert {r.target for r in mixing.source_targets(nothing).collect()} == {0.0} and mixing.source_targets(nothing.limit(0)).count() == 0


def test_many_sources_have_several_trees(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TREE_SOURCES", 3)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    table = spark.range(2000).selectExpr("id AS doc_id", "concat('s', id % 11) AS source", "repeat('w ', 1 + int(id % 7)) AS text")
    found = mixing.mix_counts(table, n_shards=4).collect()
    assert len(found) == 2000 and {s for r in found for s in r.shards} == {0, 1, 2, 3}
    for source in {r.source for r in found}:
        group = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in group) - group[0].target) <= 7


def test_taken_words_are_those_that_shards_draw(spark, monkeypatch):
    table = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('w ', 1 + int(id % 7)) AS text")
    whole = {r.doc_id: r for r in mixing.mix_counts(table, n_shards=8).collect()}
    real = mixing.split_quotas

    def lazy(quotas, n_shards, seed):
        """A tree that deals nothing to the last half of the shards."""
        dealt = real(quotas, n_shards, seed)
        dealt[n_shards // 2 :] = 0
        return dealt

    monkeypatch.setattr(mixing, "split_quotas", lazy)
    half = {r.doc_id: r for r in mixing.mix_counts(table, n_shards=8).collect()}
    drawn = sum(r.taken for r in half.values())
    assert 0 < drawn < 0.7 * sum(r.taken for r in whole.values())
    assert all(s < 4 for r in half.values() for s in r.shards)
    # what the first shards draw is the same as before, and nothing else is drawn
    lost = sum(s >= 4 for r in whole.values() for s in r.shards)
    assert lost and sum(len(r.shards) for r in half.values()) == pytest.approx(sum(len(r.shards) for r in whole.values()) - lost, abs=20)
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, n, seed: np.zeros((n, len(quotas)), np.int64))
    assert {r.taken for r in mixing.mix_counts(table, n_shards=8).collect()} == {0}


def test_words_before_blocks(spark):
    draw = random.Random(5)
    blocks = [(s, p, draw.randint(0, 9)) for s, n in (("a", 1000), ("b", 1), ("c", 64), ("d", 65), (None, 130)) for p in range(n) if p % 7 or n == 1]
    found = mixing._with_words_before(spark.createDataFrame(blocks, "source string, position long, words long"))
    want = [(s, p, w, sum(x for t, q, x in blocks if t == s and q < p)) for s, p, w in blocks]
    assert Counter(map(tuple, found.collect())) == Counter(want)


def test_shards_draw_disjoint_blocks_of_their_quotas(spark):
    table = spark.range(4000).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "repeat('w ', 1 + int(id % 5)) AS text")
    plan, narrow = mixing.mixing_plan(table, n_shards=8)
    held = {r.source: r for r in plan.collect()}
    placed = mixing._with_source(narrow, plan).withColumn("at", mixing._position(F.col("seat"), mixing._columns()))
    rows = placed.select("doc_id", "source", "at", "n_blocks", "cut", "seat").collect()
    drawn = {r.doc_id: r.shards for r in mixing.mix_counts(table, n_shards=8).collect()}
    for r in rows:
        ends, want = held[r.source].ends, []
        for epoch in range(4):
            place = epoch * r.n_blocks + r.at
            if place < ends[-1] and not (place == ends[-1] - 1 and r.cut is not None and r.seat > r.cut):
                want.append(next(k for k, end in enumerate(ends) if place < end))
        assert drawn[r.doc_id] == want


def test_splitting_tree():
    quotas = [17, 0, 300, 4]
    shares = mixing.split_quotas(quotas, 10, 3)
    assert shares.sum(axis=0).tolist() == quotas and (shares >= 0).all()
    assert set(shares.sum(axis=1)) <= {31, 32, 33, 34}
    assert (shares == mixing.split_quotas(quotas, 10, 3)).all() and (shares != mixing.split_quotas(quotas, 10, 4)).any()


def test_mixing(spark, odd, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for rows in (table, odd, docs):
        counts = mixing.mix_counts(rows, n_shards=8)
        found = counts.collect()
        assert len(found) == rows.count()
        by_source = defaultdict(list)
        for r in found:
            assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and len(r.shards) == (r.taken // r.size if r.size else len(r.shards))
            assert all(0 <= s < 8 for s in r.shards)
            by_source[r.source].append(r)
        for group in by_source.values():
            assert {r.source_size for r in group} == {sum(r.size for r in group)} and len({r.target for r in group}) == 1
            if group[0].target:
                assert abs(sum(r.taken for r in group) - group[0].target) <= max(r.size for r in group)
        assert sum(next(iter(g)).target for g in by_source.values()) == pytest.approx(sum(r.size for r in found))
        again = mixing.mix_counts(rows.repartition(5), n_shards=8).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, found))
        mixed = mixing.mix(rows, n_shards=8)
        assert mixed.columns == rows.columns
        assert Counter(r[0] for r in mixed.collect()) == +Counter({k: n for k, n in sum((Counter({r.doc_id: len(r.shards)}) for r in found), Counter()).items()})
    assert mixing.mix_counts(empty).count() == mixing.mix(empty).count() == 0


def test_pipeline(spark, docs, texts):
    held, table = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF)
        held[name] = table.collect()
        if name != "best_fit_packing":
            assert table.columns == docs.columns
            table = spark.createDataFrame(held[name], table.schema)
    assert len(held["language_id"]) == len([t for t in texts.values() if any(c.isalpha() for c in t)])
    last = {}
    for r in held["language_id"]:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert {r.doc_id for r in held["exact_dedup"]} == set(last.values())
    classes = brute_classes([(r.doc_id, r.text) for r in held["exact_dedup"]])
    assert {r.doc_id for r in held["near_dedup"]} == {c for _, c in classes}
    assert len(held["near_dedup"]) == len({c for _, c in classes})
    words = Counter()
    for r in held["source_mixing"]:
        words[r.doc_id] += len(r.text.split())
    packed = Counter()
    for r in held["best_fit_packing"]:
        packed[r.doc_id] += r.length
    assert packed == words
    assert corpus_pipeline.run(spark, SF).count() == len(held["best_fit_packing"])


def test_odd_documents_run_through(spark, odd):
    assert len(ODD) == odd.count()
    table = odd
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF)
    assert table.count() > 0
