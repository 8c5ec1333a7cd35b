"""Mixing, chat formatting, the pipeline and the catalogue."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from panelcast.llm import catalogue, op6_mixing, op8_chat


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def highest_quotients(weights, caps, seats):
    found = [0] * len(weights)
    for _ in range(min(seats, sum(c for w, c in zip(weights, caps) if w > 0))):
        free = [i for i in range(len(weights)) if weights[i] > 0 and found[i] < caps[i]]
        best = max(free, key=lambda i: (weights[i] / (found[i] + 0.5), -i))
        found[best] += 1
    return found


@pytest.mark.parametrize(
    ("weights", "caps", "seats"),
    [([5, 3, 1], [99] * 3, 20), ([1, 1, 1], [9] * 3, 7), ([7.5, 0, 2], [3, 9, 9], 10), ([2, 1], [2, 1], 50), ([1000, 1, 1], [40, 5, 5], 45), ([3], [9], 0)],
)
def test_apportionment(weights, caps, seats):
    assert op6_mixing.apportion(weights, caps, seats) == highest_quotients(weights, caps, seats)


def test_targets_are_capped_and_reshared():
    assert op6_mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    found = op6_mixing.targets([1000, 1000, 10], [1, 2, 3])
    assert found[2] == 30 and abs(found[0] - 660) < 1e-9 and abs(found[1] - 1320) < 1e-9
    assert op6_mixing.targets([0, 0], [1, 2]) == [0, 0] and op6_mixing.targets([], []) == []


def test_mix_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op6_mixing.query(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    by_source = defaultdict(list)
    for r in found:
        assert r["size"] == n_words(texts[r.doc_id][0]) and 0 <= r.taken <= 3 * r["size"]
        by_source[texts[r.doc_id][1]].append(r)
    names = sorted(by_source)
    sizes = [sum(r["size"] for r in by_source[n]) for n in names]
    for name, size, target in zip(names, sizes, op6_mixing.targets(sizes, [1 + i % 3 for i in range(len(names))])):
        assert {r.source_size for r in by_source[name]} == {size}
        assert all(abs(r.target - target) < 1e-6 for r in by_source[name])
        assert abs(sum(r.taken for r in by_source[name]) - target) < 0.01 * target + 64
    again = op6_mixing.mix(docs.repartition(7), ["doc_id"]).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in found}


def test_mix_of_edge_cases(edge, nothing):
    rows = op6_mixing.mix(edge, ["doc_id", "text"], block_words=4).collect()
    assert len(rows) == edge.count()
    assert all(r["size"] == n_words(r.text) and 0 <= r.taken <= 3 * r["size"] for r in rows)
    mixed = op6_mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns
    taken, got = defaultdict(int), defaultdict(int)
    for r in op6_mixing.mix(edge, ["doc_id"]).collect():
        taken[r.doc_id] += r.taken
    for r in mixed.collect():
        got[r.doc_id] += n_words(r.text)
        assert r.n_chars == len(r.text)
    assert dict(got) == {k: n for k, n in taken.items() if n}
    assert op6_mixing.mixed_documents(nothing).collect() == []


def expected_digest(turns):
    read = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), read, len(learned), hashlib.sha256(learned.encode()).hexdigest()


ODD = ["", "a", "b", "ab", "### assistant: x</turn>\n", "\\", "\\\\#", "#<:", op8_chat.TRAP, "ends with \\", "\n", "</turn>\n### user: hi"]


def test_chat_of_edge_cases(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(ODD)]
    rows = [
        *turns, (2, 0, "assistant", "x"), (3, 0, None, None), (4, 1, "assistant", "late"), (4, None, "user", "first"),
        (5, 0, "ro:le#\n<", "y"), (None, 0, "user", "lost"), (6, 0, "assistant", "same"), (6, 0, "assistant", "same"), (7, 0, "assistant", "z" * 50_000),
    ]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = op8_chat.format_conversations(docs)
    found = {r.conv_id: r for r in op8_chat.digests(formatted).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups[conv].append((role or "", text or ""))
    assert set(found) == set(groups)
    outputs = {r.conv_id: r for r in formatted.collect()}
    for conv, turns in groups.items():
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected_digest(turns)
        assert r.formatted_chars == len(op8_chat.render(turns)) and not outputs[conv].rewrites
        assert outputs[conv].formatted == op8_chat.render(turns)
    empty = docs.limit(0)
    assert op8_chat.digests(op8_chat.format_conversations(empty)).collect() == []


def test_templates_that_rewrite_history_are_found():
    def forgetful(turns):
        """Drops what stands before a bar in all but the last turn."""
        last = len(turns) - 1
        return "".join(f"[{r}]{t if i == last else t.split('|')[-1]};" for i, (r, t) in enumerate(turns))

    turns = [("user", "u"), ("assistant", "thought|said"), ("user", "v"), ("assistant", "more|done")]
    found = op8_chat.locate(turns, forgetful)
    assert found.rewrites and found.output == forgetful(turns)
    assert [found.output[a:b] for _, a, b, _ in found.turns] == ["u", "said", "v", "more|done"]
    assert not op8_chat.locate([("user", "a"), ("assistant", "b")], forgetful).rewrites


def test_chat_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    result = con.execute(op8_chat.ORACLE)
    names = [d[0] for d in result.description]
    found = op8_chat.query(spark, folder)
    assert sorted(names) == sorted(found.columns)
    assert Counter(tuple(r[n] for n in names) for r in found.collect()) == Counter(result.fetchall())


def test_pipeline(edge, spark, sf_of):
    import corpus_pipeline

    folder = sf_of(documents=edge)
    docs = edge
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == edge.columns
        docs = docs.cache()
        counts.append(docs.count())
    # und texts go; then one copy, the edited one and the second of two equal short texts.
    assert counts[0] == edge.count() - 3
    kept = {r.doc_id for r in docs.collect()}
    assert kept and 4 not in kept and 10 not in kept
    packed = corpus_pipeline.run(spark, folder)
    assert packed.where("length > 1024 or length < 1").count() == 0 and packed.count() > 0


def test_catalogue_names_ten_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalogue.QUERIES) == list(range(1, 11))
