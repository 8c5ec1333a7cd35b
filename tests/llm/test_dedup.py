"""Near duplicates and repeated substrings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from panelcast.llm import op2_near_dups, op4_repeats, union_find


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_edge_cases(edge, n, percent):
    rows = op2_near_dups.near_duplicates(edge, words=n, percent=percent).collect()
    expected = brute_components([(r.doc_id, r.text) for r in edge.collect()], n, percent)
    assert len(rows) == edge.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2


def test_near_duplicates_of_nothing(nothing):
    assert op2_near_dups.near_duplicates(nothing).collect() == []


def test_group_of_copies_that_differ_from_each_other(spark):
    """A source with near and far copies: far ones stay alone, chains are followed."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(150)]

    def copy(edits):
        words = list(base)
        for at in rng.sample(range(150), edits):
            words[at] = f"v{rng.randint(0, 9999)}"
        return " ".join(words)

    texts = [copy(rng.choice([0, 1, 2, 3, 5, 8, 14])) for _ in range(150)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    found = op2_near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == brute_components(rows, 3, 85)
    assert 10 < len({c for _, c in got.values()}) < 140


def test_signature_is_a_permutation_with_early_stop():
    """The stopped signature equals the one of all steps, and agreement estimates similarity."""
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64)
    sets = [keys[:300], keys[100:400]]
    owners = np.repeat([0, 1], 300)
    found = op2_near_dups.super_minhash(owners, np.concatenate(sets), 2, 1024)
    assert abs((found[0] == found[1]).mean() - 0.5) < 0.06
    assert (found >> np.uint64(53)).max() < 40
    one = op2_near_dups.super_minhash(np.zeros(1, dtype=int), keys[:1], 1, 64)
    assert sorted((one[0] >> np.uint64(53)).tolist()) == list(range(64))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    found = union_find.components(spark.createDataFrame(edges, "a long, b long"))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r.node: r.root for r in found.collect()} == {x: find(x) for x in root if find(x) != x}
    assert union_find.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length=100):
    """By key, then text; equal rows are one document."""
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, _name(r[1]))):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[key, text] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def _name(text):
    return xxhash.xxh64((text or "").encode(), seed=42).intdigest()


def test_repeats_of_edge_cases(edge):
    found = op4_repeats.remove_repeats(edge, ["doc_id", "text"]).collect()
    expected = brute_repeats([(r.doc_id, r.text) for r in edge.collect()])
    got = Counter((r.doc_id, r.text, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found)
    wanted = Counter((r.doc_id, r.text, *expected[r.doc_id, r.text]) for r in edge.collect())
    assert got == wanted
    assert sum(r.n_removed for r in found) > 1000


def test_repeats_of_passages_periods_and_zeros(spark):
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choice("abcdef ghijé") for _ in range(n))

    passages = [noise(k) for k in (99, 100, 101, 260, 700)]
    texts = [noise(rng.randint(0, 400)) for _ in range(40)]
    for i in range(40, 120):
        texts.append(noise(rng.randint(0, 90)) + rng.choice(passages) + noise(rng.randint(0, 90)) + rng.choice(passages))
    texts += ["ab" * 200, "ab" * 150, "\0" * 350, "\0" * 120, passages[3][40:] + passages[4][:330], None, ""]
    rows = list(enumerate(texts))
    found = op4_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ["doc_id"])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found.collect()}
    assert got == {k: v for (k, _), v in brute_repeats(rows).items()}


def test_repeats_of_nothing(nothing):
    assert op4_repeats.remove_repeats(nothing, ["doc_id"]).collect() == []


def test_queries_over_a_folder(edge, sf_of, spark):
    folder = sf_of(documents=edge)
    assert op4_repeats.query(spark, folder).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert op2_near_dups.query(spark, folder).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_large_star_of_hub(spark):
    edges = [(0 if i % 2 else 5000, i) for i in range(1, 400)] + [(0, 5000)]
    found = defaultdict(int)
    for r in union_find.components(spark.createDataFrame(edges, "a long, b long")).collect():
        found[r.root] += 1
    assert dict(found) == {0: 400}


def sentence(rng, words):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(words))


def test_clean_texts_without_keys_keep_their_bytes(spark):
    """Thousands of texts without a key are told apart: only what repeats goes."""
    rng = random.Random(9)
    passage = sentence(rng, 60)
    rows = [(None, f"{i:05d} {sentence(rng, 12)} {passage}") for i in range(700)] + [(None, f"{i:05d} {sentence(rng, 30)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = op4_repeats.remove_repeats(docs, ["text"]).select("text", "n_removed").collect()
    touched = [r for r in found if r.n_removed]
    assert len(found) == len(rows) and len(touched) == 699 and all(passage in r.text for r in touched)
