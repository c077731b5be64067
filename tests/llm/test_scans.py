"""Licences, language, toxicity and media against brute force, round trips and held-out accuracy."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import language_id, license_scan, media, toxicity
from keyloom.llm.common import pick
from tests.llm.conftest import ODD

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_matching_statistics():
    scanner = license_scan.LicenseScanner()
    sequences = [t.encode().split() for _, t in license_scan.TEMPLATES] + [p.encode().split() for p in license_scan.BASE]
    parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    draw = random.Random(5)
    for _ in range(60):
        text: list[bytes] = []
        while len(text) < 50:
            s = draw.choice(sequences)
            at = draw.randrange(len(s))
            text += s[at : at + draw.randint(1, 8)] + [b"zz"] * draw.randint(0, 1)
        got = {k: n for k, _, n in scanner.automaton.walk(text)}
        for k in range(len(text)):
            assert got.get(k, 0) == max((n for n in range(1, k + 2) if tuple(text[k - n + 1 : k + 1]) in parts), default=0)


def test_licenses(spark, odd, docs, empty, texts):
    more = ["All rights reserved. all RIGHTS-reserved CC by", "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files (the Software), to deal in the Software without restriction"]
    extra = spark.createDataFrame([(k, t) for k, t in enumerate(more)], "doc_id long, text string")
    for table, rows in ((odd, [r[:2] for r in ODD]), (docs, list(texts.items())), (extra, list(enumerate(more)))):
        want = []
        for doc_id, text in rows:
            w, starts, labels = words(text), [], set()
            for phrase, label in license_scan.BASE.items():
                p = phrase.split()
                here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
                starts += here
                labels |= {label} if here else set()
            want.append((doc_id, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
        got = license_scan.scan_licenses(table).collect()
        assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(map(repr, want))
        assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in got)
    got = {r.doc_id: r for r in license_scan.scan_licenses(extra).collect()}
    assert got[0].labels == "cc-by,reserved" and got[1].labels == "mit" and got[2].labels == "mit"
    assert got[2].spans[0].cover > 0.9 and license_scan.scan_licenses(empty).count() == 0


def test_no_template_hides_another():
    """On mutated notices, a scanner of all templates finds what scanners of single ones find."""
    draw = random.Random(6)
    joint = license_scan.LicenseScanner()
    alone = [license_scan.LicenseScanner(templates=[t]) for t in license_scan.TEMPLATES]
    fuller = 0
    for _ in range(1500):
        text: list[str] = []
        for _ in range(draw.randint(1, 3)):
            k = draw.randrange(len(license_scan.TEMPLATES))
            notice = license_scan.TEMPLATES[k][1].split()
            for _ in range(draw.randint(0, 1 + len(notice) // 8)):
                at = draw.randrange(len(notice))
                notice[at : at + draw.randint(0, 1)] = draw.choice([["zz"], [], notice[at : at + 1] * 2, draw.choice(license_scan.TEMPLATES)[1].split()[:4]])
                notice = notice or ["zz"]
            text += notice + ["xx"] * draw.randint(0, 8)
        whole = joint.scan(" ".join(text))
        for scanner, (label, _) in zip(alone, license_scan.TEMPLATES, strict=True):
            one = scanner.scan(" ".join(text))
            assert label in whole.labels or label not in one.labels
            assert [s for s in one.spans if s not in whole.spans] == []
            fuller += len(one.spans)
    assert fuller > 2000


def test_chains_against_brute_force():
    """Best cover of a template by any chain of its matches, over all subsets of few matches."""
    from itertools import combinations

    draw = random.Random(2)
    for _ in range(200):
        words = [f"t{k}" for k in range(12)]
        text: list[str] = []
        for _ in range(3):
            at = draw.randrange(10)
            text += words[at : at + draw.randint(2, 5)] + ["zz"] * draw.randint(0, 4)
        scanner = license_scan.LicenseScanner(min_match=2, max_gap=3, min_cover=0.01, templates=[("t", " ".join(words))])
        found = set()
        for s in range(len(text)):
            for f in range(12):
                n = 0
                while s + n < len(text) and f + n < 12 and text[s + n] == words[f + n]:
                    n += 1
                if n >= 2 and not (s and f and text[s - 1] == words[f - 1]):
                    found.add((s, s + n - 1, f + n))
        best = 0
        for r in range(1, len(found) + 1):
            for chain in combinations(sorted(found), r):
                total, ok = 0, True
                for k, (s, e, reached) in enumerate(chain):
                    n, overlap = e - s + 1, 0
                    if k:
                        _, before, upto = chain[k - 1]
                        overlap = max(0, before + 1 - s, upto - (reached - n))
                        ok &= s - before - 1 <= 3 and reached - n - upto <= 3 and overlap < n and e > before and reached > upto
                    total += n - overlap
                best = max(best, total if ok else 0)
        assert scanner.scan(" ".join(text)).score == pytest.approx(min(1, best / 12))


def test_template_table(spark, odd):
    notice = "You are free to use these works as long as You keep this notice, whole and unchanged, in every copy of them."
    table = spark.createDataFrame([("own", notice, 1), ("", "x", 2), (None, "y z", 3), ("none", None, 4)], "label string, text string, TEXT int")
    docs = spark.createDataFrame([(1, f"Intro. {notice.upper()} CC by 4.0"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs, templates=table).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].score) == ("cc-by,own", "cc-by", 1.0) and got[2].labels == got[3].labels == ""
    assert [tuple(s) for s in got[1].spans] == [("own", 1, 22, 1.0)]
    assert license_scan.scan_licenses(odd, templates=table.limit(0)).count() == odd.count()


def test_language(spark, odd, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(table.where(~language_id.held_out()))
    truth = {r.doc_id: r.lang for r in table.where(language_id.held_out()).collect()}
    found = {r.doc_id: r for r in language_id.identify(table, model).collect()}
    assert np.mean([found[i].lang_pred == lang for i, lang in truth.items()]) > 0.98
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()]
    assert len(got) == len(ODD) and {i for i, lang, _ in got if lang == "und"} == {4, 5, 6, None}
    assert len({(lang, s) for i, lang, s in got if i == 8}) == 1
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert nothing.labels == () and {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.keep_identified(empty).count() == 0
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and {4, 5, 6}.isdisjoint(r[0] for r in kept.collect())


def random_model():
    draw = np.random.default_rng(3)
    counts = draw.integers(0, 500, (1 << 10, 3))
    return language_id.model_of(("a", "b", "c"), counts, counts // 2, np.ones(3), 10, (2, 3))


def test_language_score_ignores_company():
    model = random_model()
    texts = ["hello there", "x", "a longer text " * 900, None, "été"]
    together = language_id.score_texts(model, texts)
    alone = [language_id.score_texts(model, [t]) for t in texts]
    assert [a[0][0] for a in alone] == together[0] and [a[1][0] for a in alone] == list(together[1])


def test_language_scores_by_passes_of_any_size(texts):
    model = random_model()
    long = " ".join(texts.values())
    long = (long * (1 + 1_000_000 // len(long)))[:1_000_000] + " \u0130\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2"
    rows = [long, "x", "\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2 \u0130 " * 9, "two words"]
    whole = language_id.score_texts(model, rows, limit=1 << 30)
    for limit in (1 << 18, 1000, 7):
        some = language_id.score_texts(model, rows, limit=limit)
        assert some[0] == whole[0] and list(some[1]) == list(whole[1]) and list(some[2]) == list(whole[2])


def test_language_against_plain_counting(spark):
    """Counts, log-probabilities, priors and scores by plain Python over n-grams, each put in its bucket by itself."""
    import math
    from collections import Counter

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(~language_id.held_out())
    model = language_id.fit(rows, bits=12)
    held = [(r.text, r.lang) for r in rows.collect()]
    buckets = {}

    def bucket(gram):
        if gram not in buckets:
            points = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
            piece = [(0, points, 0)]
            buckets[gram] = next(int(b[0]) for b, *_ in language_id.ngram_buckets(piece, 12, (len(gram),)))
        return buckets[gram]

    def grams(text):
        text = f" {text.lower()} "
        return [bucket(text[k : k + n]) for n in (2, 3) for k in range(len(text) - n + 1)]

    counts, docs = {}, Counter(lang for _, lang in held)
    for text, lang in held:
        if any(c.isalpha() for c in text):
            counts.setdefault(lang, Counter()).update(grams(text))
    assert model.labels == tuple(sorted(counts))
    for k, lang in enumerate(model.labels):
        total = sum(counts[lang].values()) + 0.5 * 4096
        for b in range(0, 4096, 37):
            assert model.log_probs[b, k] == pytest.approx(math.log((counts[lang][b] + 0.5) / total), abs=1e-5)
        assert model.priors[k] == pytest.approx(math.log((docs[lang] + 1) / (len(held) + len(docs))))
    for text, _ in held[:25]:
        sums = [model.priors[k] + sum(float(model.log_probs[b, k]) for b in grams(text)) for k in range(len(model.labels))]
        langs, scores, _ = language_id.score_texts(model, [text])
        assert langs[0] == model.labels[int(np.argmax(sums))] and scores[0] == pytest.approx(1 / sum(math.exp(x - max(sums)) for x in sums))


def test_rare_languages_and_junk(spark):
    """A language with few rows is learned from all of them, copies don't rule the sample, and letters that are no words go."""
    draw = random.Random(3)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randint(2, 8)))
    text = lambda letters, n=30: " ".join(word(letters) for _ in range(n))
    rows = [(k, text("aeionrst"), "big") for k in range(3000)] + [(k, "same text of one large group of copies", "big") for k in range(3000, 5000)]
    rows += [(k, text("bcdfgzxq"), "rare") for k in range(5000, 5012)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table, sample_docs=200)
    assert model.labels == ("big", "rare") and model.priors[0] - model.priors[1] == pytest.approx(np.log(5001 / 13))
    langs, *_ = language_id.score_texts(model, [text("bcdfgzxq") for _ in range(50)] + [text("aeionrst") for _ in range(50)])
    assert langs == ["rare"] * 50 + ["big"] * 50
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = [(10**6 + k, text("abcdefghijklmnopqrstuvwxyz", 60), None) for k in range(20)] + [(2 * 10**6, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 30, None)]
    both = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    kept = [r.doc_id for r in language_id.keep_identified(both).collect()]
    assert max(kept) < 10**6 and len(kept) == docs.where(F.col("text").rlike(r"\p{L}")).count()
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(spark.range(1001).selectExpr("'a b' AS text", "string(id) AS lang"))


def test_ordinal_gradient_and_thresholds():
    draw = np.random.default_rng(1)
    hits = [sorted(draw.choice(5, draw.integers(0, 4), replace=False).tolist()) for _ in range(400)]
    truth = np.array([0.0, 1.0, 2.0, -1.0, 0.5])
    total = np.array([truth[h].sum() for h in hits]) + draw.logistic(size=400)
    grade = (total > 0.5).astype(int) + (total > 2)
    w, thresholds = toxicity.fit_ordinal(hits, grade, 5, steps=1500)

    def loss(w, thresholds):
        scores = np.array([w[h].sum() for h in hits])
        above = np.hstack([np.ones((400, 1)), 1 / (1 + np.exp(thresholds - scores[:, None])), np.zeros((400, 1))])
        rows = np.arange(400)
        return -np.log(above[rows, grade] - above[rows, grade + 1]).mean()

    assert np.all(np.diff(thresholds) > 0) and np.abs(w - truth).max() < 0.6
    best = loss(w, thresholds)
    for k in range(5):
        for step in (-0.05, 0.05):
            assert loss(w + step * np.eye(5)[k], thresholds) > best - 1e-5


def test_toxicity(spark, odd, empty):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 4 = 2")
    model = toxicity.fit(table, labels.where("doc_id % 4 <> 2"))
    found = {r.doc_id: r for r in toxicity.grade_documents(table, model).collect()}
    rows = [(found[r.doc_id], r.toxic) for r in held.collect()]
    assert np.mean([f.toxic for f, toxic in rows if toxic]) > 0.8
    assert np.mean([f.toxic for f, toxic in rows if not toxic]) < 0.03
    assert all(0 <= f.severity <= 2 and f.grade == round(f.severity) for f, _ in rows)
    assert toxicity.grade_documents(odd, model).count() == len(ODD) and toxicity.grade_documents(empty, model).count() == 0
    blank = toxicity.fit(table, labels.limit(0))
    assert {(r.severity, r.toxic) for r in toxicity.grade_documents(odd, blank).collect()} == {(0.0, False)}


def test_toxicity_against_plain_sums(spark, odd):
    """Features and severity of each text by regular expressions and plain sums; odd labels count as stated."""
    import math

    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(None, 1, 1), (10**12, 1, 1), (10**12, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    judged = toxicity.judged(labels.unionByName(extra).select("*", F.lit("x").alias("TOXIC")))
    seen = {r.doc_id: r.toxic for r in judged.where("doc_id = 1000000000000 OR doc_id IS NULL").collect()}
    assert seen == {10**12: 1} and judged.count() == labels.select("doc_id").distinct().count() + 1
    model = toxicity.fit(table, labels.unionByName(extra))
    again = toxicity.fit(table.repartition(7), labels.repartition(5))
    assert model.weights == again.weights
    found = {r.doc_id: r for r in toxicity.grade_documents(table, model).collect()}
    for r in table.limit(300).collect():
        known = set()
        for w in {x.encode() for x in words(r.text)}:
            known |= {f for f in [w, *(w[:n] + b"*" for n in (4, 5, 6, 7) if len(w) > n)] if f in model.weights}
        total = sum(model.weights[f] for f in sorted(known)) + (model.any_weight if known else 0)
        above = [1 / (1 + math.exp(min(60, max(-60, t - total)))) for t in model.thresholds]
        assert found[r.doc_id].severity == pytest.approx(sum(above)) and found[r.doc_id].p_toxic == pytest.approx(above[0])


def test_rare_toxic_labels_are_learned(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    bad = labels.where("toxic = 1").orderBy("doc_id")
    rare = labels.where("toxic = 0").unionByName(bad.limit(60))
    model = toxicity.fit(table, rare)
    found = {r.doc_id: r.toxic for r in toxicity.grade_documents(table, model).collect()}
    rows = [(found[r.doc_id], r.toxic) for r in labels.collect()]
    assert np.mean([f for f, toxic in rows if toxic]) > 0.5
    assert np.mean([f for f, toxic in rows if not toxic]) < 0.03


def test_class_shares():
    assert toxicity.class_shares(100, 5, 8000) == (1, 1)
    assert toxicity.class_shares(79_900, 100, 8000) == (7900 / 79_900, 1)
    assert toxicity.class_shares(100_000, 100_000, 8000) == (0.04, 0.04)


def test_media_round_trip(odd, docs, empty):
    for table in (odd, docs):
        table = table.where("doc_id IS NOT NULL")
        rows = {r.doc_id: r.text or "" for r in pick(table, "doc_id", "text").collect()}
        found = media.media_features(media.text_media(table)).collect()
        assert len(found) == table.count()
        for r in found:
            data = rows[r.doc_id].encode()
            padded = data.ljust(max(1, -(-len(data) // 192)) * 192)
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(padded), zlib.crc32(padded[-16:]))
            assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.error is None
    assert media.media_features(media.text_media(odd)).count() == len(ODD)
    assert media.media_features(media.text_media(empty)).count() == 0


def test_media_reads_formats_and_refuses_others(spark):
    pixels = np.random.default_rng(0).integers(0, 256, (5, 3, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all() and (media.decode(media.encode_ppm(pixels)) == pixels).all()
    assert (media.decode(media.encode_ppm(pixels[:, :, 0])) == pixels[:, :, 0]).all()
    assert media.decode(b"P2 # note\n2 2\n255\n1 2 3 4\n").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P2 2 2 9 0 3 6 9\n").tolist() == [[0, 85], [170, 255]]
    assert media.decode(b"P1\n3 1\n101").tolist() == [[0, 255, 0]] and media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    white = media.decode(b"P5\n20 20\n15\n" + bytes([15]) * 400)
    assert white.min() == 255 and np.load(io.BytesIO(media.tile(white))).min() == 255
    deep = media.decode(b"P5 20 20 65535\n" + (384).to_bytes(2, "big") * 400)
    assert deep.dtype == np.uint16 and set(np.load(io.BytesIO(media.tile(deep))).ravel()) == {1}
    wrong = [b"P5 99999999999 99999999999 255\n", b"P2 2 2 70000 1 1 1 1", b"P2 2 2 255 1 -5 1 1", b"P3 1 1 255 300 1 1", b"P5 3 3 0\n" + bytes(9), b"P5 99999 99999 255\nxx"]
    for bad in (b"", b"GIF89a", b"P6\n9 9\n255\nxx", b"BM123", b"P9 1 1 1 0", *wrong):
        with pytest.raises(media.MediaError):
            media.decode(bad)
    table = spark.createDataFrame([(1, 0, None), (2, 3, b"junk"), (3, 9, media.encode_ppm(pixels))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.media_features(table).collect()}
    assert got[1].error and got[2].error and got[2].media_bytes == 4 and got[3].error is None and got[3].width == 3


def test_mutated_images_never_raise_anything_else():
    draw = random.Random(8)
    pixels = np.random.default_rng(0).integers(0, 256, (6, 5, 3), dtype=np.uint8)
    good = [media.encode_bmp(pixels), media.encode_ppm(pixels), b"P2 2 2 9 1 2 3 4", b"P3 1 1 9 1 2 3", b"P1 3 1 101", b"P4\n3 1\n\xa0", b"P5 2 1 300\n\x00\x01\x00\x02"]
    read = 0
    for _ in range(10_000):
        data = bytearray(draw.choice(good))
        for _ in range(draw.randint(1, 4)):
            at = draw.randrange(min(len(data), 60))
            what = draw.random()
            if what < 0.5:
                data[at] = draw.choice(b"0123456789- \n#\xff\x00") if draw.random() < 0.7 else draw.randrange(256)
            elif what < 0.75:
                del data[at : at + draw.randint(1, 9)]
            else:
                data[at:at] = draw.choice([b"9" * 12, b"-", b"\xff\xff\xff\x7f"])
            data = data or bytearray(b"P")
        made = media._features(bytes(data))
        read += "error" not in made
        assert "error" in made or len(made["tile_npy"]) > 100
    assert read > 500


def test_area_resize_in_strips(monkeypatch):
    pixels = np.random.default_rng(0).integers(0, 256, (97, 13, 3), dtype=np.uint8)
    whole = [media.area_resize(pixels, *size) for size in ((5, 4), (97, 13), (200, 30), (1, 1))]
    monkeypatch.setattr(media, "STRIP", 100)
    for want, size in zip(whole, ((5, 4), (97, 13), (200, 30), (1, 1)), strict=True):
        assert np.allclose(media.area_resize(pixels, *size), want)
    plain = pixels.astype(float)
    integral = np.pad(plain.cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
    assert np.allclose(media.area_resize(pixels, 1, 13)[0], np.diff(integral[-1], axis=0) / 97)


def test_features_against_brute_force(texts):
    """Tile and difference hash by plain loops over fractions of pixels."""
    from fractions import Fraction

    def mean(pixels, axis_parts):
        (y0, y1), (x0, x1) = axis_parts
        total, area = [Fraction(0)] * 3, (y1 - y0) * (x1 - x0)
        for y in range(int(y0), -int(-y1 // 1)):
            for x in range(int(x0), -int(-x1 // 1)):
                part = (min(y1, y + 1) - max(y0, y)) * (min(x1, x + 1) - max(x0, x))
                for c in range(3):
                    total[c] += part * int(pixels[y, x, c])
        return [t / area for t in total]

    for text in [t for t in texts.values() if 300 < len(t) < 3000][:3]:
        _, data = media.payload_image(text)
        pixels = media.decode(data)
        h, w = pixels.shape[:2]
        parts = lambda n, size: [(Fraction(k * size, n), Fraction((k + 1) * size, n)) for k in range(n)]
        small = np.load(io.BytesIO(media.tile(pixels)))
        for i, y in list(enumerate(parts(16, h)))[::5]:
            for j, x in list(enumerate(parts(16, w)))[::5]:
                assert all(abs(float(m) - int(got)) <= 0.5 + 1e-6 for m, got in zip(mean(pixels, (y, x)), small[i, j], strict=True))
        bits = 0
        for y in parts(8, h):
            greys = [sum(m * c for m, c in zip(mean(pixels, (y, x)), (299, 587, 114), strict=True)) / 1000 for x in parts(9, w)]
            for a, b in zip(greys, greys[1:], strict=False):
                bits = bits << 1 | (a < b)
        assert bits == media.difference_hash(pixels)


def test_area_resize_and_hash():
    pixels = np.random.default_rng(0).integers(0, 256, (12, 10))
    assert np.allclose(media.area_resize(pixels, 4, 5), pixels.reshape(4, 3, 5, 2).mean(axis=(1, 3)))
    for size in ((3, 7), (24, 20), (1, 1)):
        assert np.isclose(media.area_resize(pixels, *size).mean(), pixels.mean())
    ramp = np.tile(np.arange(64), (32, 1))
    assert media.difference_hash(ramp) == 2**64 - 1 and media.difference_hash(ramp[:, ::-1]) == 0
