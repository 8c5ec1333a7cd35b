"""Language identification, fingerprints, quality rules and classifier."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import common, kneser_ney, op3_language, op5_fingerprints, op9_classifier, op10_quality

SF = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- language -------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    docs = common.table(spark, SF, "documents")
    rows = op3_language.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < 300 and len(rows) == docs.count()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.99
    assert not any(r.rejected for r in rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_edge_cases(edge, nothing, spark, sf_of):
    folder = sf_of(documents=edge)
    rows = op3_language.query(spark, folder).collect()
    by_text = {r.doc_id: r for r in rows}
    assert len(rows) == edge.count()
    for key in (1, 2, 3):
        assert (by_text[key].lang_pred, by_text[key].score, by_text[key].rejected) == ("und", 0.0, True)
    assert {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    untrained = op3_language.identify(edge, op3_language.fit(nothing)).collect()
    assert {r.lang_pred for r in untrained} == {"und"}
    assert op3_language.identify(nothing, op3_language.fit(edge)).collect() == []


def test_foreign_noise_is_rejected(spark):
    docs = common.table(spark, SF, "documents")
    identifier = op3_language.fit(docs)
    rng = random.Random(1)
    noise = "".join(chr(rng.randint(0x4E00, 0x6000)) for _ in range(300))
    found = op3_language.identify(spark.createDataFrame([(1, noise)], "doc_id long, text string"), identifier).first()
    assert found.rejected


def test_kneser_ney_sums_to_one_and_matches_a_plain_version():
    text = "abracadabra banana bandana"
    keys, bounds = kneser_ney.grams([text])
    assert bounds.tolist() == [0, len(text) + 1]
    gram, n = np.unique(keys, return_counts=True)
    letters = sorted({int(k) & 0xFFFF for k in gram})
    model = kneser_ney.one_language("x", gram, n, len(letters) + 1)

    counts = Counter({int(g): int(c) for g, c in zip(gram, n)})
    levels = {4: dict(counts)}
    for order in (3, 2, 1):
        lower = Counter()
        for g in levels[order + 1]:
            lower[g & ((1 << 16 * order) - 1)] += 1
        levels[order] = dict(lower)

    def discount(level):
        once, twice = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
        return once / (once + 2 * twice) if once and twice else 0.5

    def probability(g, order):
        if order == 0:
            return 1 / (len(letters) + 1)
        level = levels[order]
        followers = {x: c for x, c in level.items() if x >> 16 == g >> 16}
        lower = probability(g & ((1 << 16 * (order - 1)) - 1), order - 1)
        if not followers:
            return lower
        d, total = discount(level), sum(followers.values())
        return max(level.get(g, 0) - d, 0) / total + d * len(followers) / total * lower

    contexts = {g >> 16 for g in counts} | {(ord("z") << 32) | (ord("b") << 16) | ord("a")}
    for context in contexts:
        asked = np.array([(context << 16) | c for c in letters], dtype=np.uint64)
        got = np.exp(model.log_probabilities(asked)[:, 0])
        assert np.allclose(got, [probability(int(a), 4) for a in asked], rtol=1e-4)
        unknown = np.exp(model.log_probabilities(np.array([(context << 16) | 9999], dtype=np.uint64))[0, 0])
        assert abs(got.sum() + unknown - 1) < 1e-4


# --- fingerprints ---------------------------------------------------------


def shingle_set(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check_fingerprints(rows, found):
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    texts = [r.text or "" for r in order]
    errors = []
    wanted = Counter()
    for i, r in enumerate(order):
        t, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        wanted[r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
        hits = [f for f in found if (f.doc_id, f.n_chars, f.edited_sha256) == (r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest())]
        errors += [h.near_edited - jaccard(t, edited) for h in hits] + [h.near_next - jaccard(t, after) for h in hits]
    assert Counter((f.doc_id, f.n_chars, f.edited_sha256) for f in found) == wanted
    return np.abs(errors)


@pytest.mark.parametrize("partitions", [1, 4])
def test_fingerprints_of_edge_cases(edge, spark, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions == 1)
    found = op5_fingerprints.edited_fingerprints(edge).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    errors = check_fingerprints(edge.collect(), found)
    assert errors.max() < 0.25 and errors.mean() < 0.03
    same = {r.doc_id: bytes(r.fingerprint) for r in found}
    assert same[0] == same[4] and same[9] == same[10] and same[1] == same[2] == same[3] == b""


def test_fingerprint_estimates_are_unbiased():
    rng = random.Random(4)
    errors = []
    for _ in range(150):
        words = [str(rng.random()) for _ in range(260)]
        cut = rng.randint(0, 200)
        one, two = " ".join(words[:220]), " ".join(words[cut:])
        prints = op5_fingerprints.fingerprint(pa.array([one, two]))
        errors.append(op5_fingerprints.likeness(prints[:1], prints[1:])[0] - jaccard(one, two))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


def test_one_document_follows_itself(spark, nothing):
    one = spark.createDataFrame([(3, "a b c d e f g")], "doc_id long, text string")
    found = op5_fingerprints.edited_fingerprints(one).first()
    assert found.near_next == 1.0 and found.n_chars == 13
    assert op5_fingerprints.edited_fingerprints(nothing).collect() == []


# --- quality rules --------------------------------------------------------


def brute_rules(text):
    text = text or ""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    words = [text[a:b] for a, b in spans]
    seen, dup_lines, line_words, at = set(), 0, set(), 0
    for line in text.split("\n"):
        if words_of(line):
            if line in seen:
                dup_lines += 1
                line_words |= {k for k, (a, _) in enumerate(spans) if at <= a < at + len(line)}
            seen.add(line)
        at += len(line) + 1
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {i + k for i in range(len(words) - 2) for k in range(3) if tri[tuple(words[i : i + 3])] > 1}
    coverage = []
    for n in op10_quality.NGRAM_LIMITS:
        known, inside = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in known:
                inside |= set(range(i, i + n))
            known.add(gram)
        coverage.append(sum(len(words[k]) for k in inside) / max(1, sum(map(len, words))))
    chars = sum(map(len, words))
    lines = sum(len(words[k]) for k in line_words) / max(1, chars)
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    bad = any(c > limit for c, limit in zip(coverage, op10_quality.NGRAM_LIMITS.values())) or lines > op10_quality.LINE_LIMIT
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (len(words), chars, symbols, dup_lines, len(repeat), failed, not failed and not bad), coverage, lines


def test_quality_rules_of_edge_cases_and_documents(edge, nothing, spark):
    sample = common.table(spark, "/root/testdata/sf0.001", "documents")
    for docs in (edge, sample):
        texts = Counter()
        for r in docs.collect():
            texts[r.doc_id, *brute_rules(r.text)[0]] += 1
        found = op10_quality.quality_rules(docs).collect()
        got = Counter(
            (f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, f.kept) for f in found
        )
        assert got == texts
    measures = op10_quality.measure(pa.array([r.text for r in edge.collect()]))
    for i, r in enumerate(edge.collect()):
        _, coverage, lines = brute_rules(r.text)
        assert np.allclose(measures["ngram_coverage"][i], coverage) and np.isclose(measures["line_coverage"][i], lines)
    assert op10_quality.quality_rules(nothing).collect() == []


# --- classifier -----------------------------------------------------------


def test_classifier_on_held_out_documents(spark):
    rows = op9_classifier.query(spark, SF)
    labels = common.table(spark, SF, "labels").groupBy("doc_id").agg({"quality": "max"}).toDF("doc_id", "quality")
    found = rows.join(labels, "doc_id").where("held_out").collect()
    assert rows.count() == 1000 and len(found) > 50
    good, bad = [[r.score for r in found if r.quality == q] for q in (1, 0)]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.93
    assert all((r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1 for r in found)


def test_classifier_of_edge_cases(edge, nothing, spark):
    labels = spark.createDataFrame([(0, 1.0), (0, 0.0), (13, 0.0), (14, 0.0), (16, 1.0), (99, 1.0), (None, 1.0), (2, None)], "doc_id long, label double")
    model = op9_classifier.fit(edge, labels)
    assert len(model.labels) == 4
    rows = op9_classifier.score(edge, model).collect()
    assert len(rows) == edge.count()
    assert {r.score for r in rows if r.doc_id in (1, 2)} == {float(model.labels.mean())}
    again = op9_classifier.score(edge, op9_classifier.fit(edge.repartition(2), labels)).collect()
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in rows) == sorted((r.doc_id or -1, round(r.score, 6)) for r in again)
    unlabelled = op9_classifier.fit(edge, labels.where("label > 5"))
    assert {r.score for r in op9_classifier.score(edge, unlabelled).collect()} == {0.0}
    assert op9_classifier.score(nothing, op9_classifier.fit(nothing, labels)).collect() == []


def test_vote_is_exact_nearest_neighbours():
    rng = np.random.default_rng(0)
    sample, asked = rng.integers(0, 9, (60, op9_classifier.FEATURES)), rng.integers(0, 9, (20, op9_classifier.FEATURES))
    labels = rng.integers(0, 2, 60).astype(float)
    idf = np.ones(op9_classifier.FEATURES)
    projection = rng.normal(size=(op9_classifier.FEATURES, 8)).astype(np.float32)
    model = op9_classifier.Model(idf, projection, np.zeros((0, 8), np.float32), labels)
    model.vectors = model.latent(sample)
    near = np.round(model.latent(asked) @ model.vectors.T, 5)
    for got, row in zip(model.vote(asked, 5), near):
        best = np.argsort(-row)[:5]
        weights = np.maximum(row[best], 0).astype(float) ** op9_classifier.SHARPNESS
        assert np.isclose(got, weights @ labels[best] / weights.sum())
