"""The mix carries texts through one shuffle and makes whole and partial rows in one pass."""

import contextlib
import io
import re
from collections import Counter

from panelcast.llm import common, op6_mixing


def documents(spark):
    rows = [(i % 290 if i % 41 else None, None if i % 7 == 0 else "abc"[i % 3], " ".join(f"{i}x{j}é" for j in range(i % 97)), i) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")


def test_texts_are_shuffled_once(spark):
    """Nor are they broadcast, or shuffled by source, when Spark knows nothing of the sizes."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        mixed, plan = op6_mixing.mixed_documents(documents(spark)), io.StringIO()
        with contextlib.redirect_stdout(plan):
            mixed.explain("formatted")
    finally:
        spark.conf.set(setting, before)
    moved = re.findall(r"\) (?:Broadcast)?Exchange *\nInput \[\d+\]: \[(.*)\]", plan.getvalue())
    assert len(moved) > 1
    assert sum("_kept" in columns or "text" in columns for columns in moved) == 1


def test_whole_and_partial_rows_are_those_of_the_mix(spark):
    docs = documents(spark).localCheckpoint()
    expected = Counter()
    for r in op6_mixing.mix(docs, ["doc_id", "source", "text", "n_chars"]).collect():
        kept = (r.doc_id, r.source)
        spans = [m.span() for m in re.finditer(common.WORD, r.text)]
        if r["size"]:
            expected[*kept, r.text, r.n_chars] += r.full
        runs, last = [], False
        for (a, b), take in zip(spans, op6_mixing.chosen(r.begin, r["size"], r.words, r.extra, r.turn)):
            if take and last:
                runs[-1][1] = b
            elif take:
                runs.append([a, b])
            last = take
        if runs:
            part = "\n".join(r.text[a:b] for a, b in runs)
            expected[*kept, part, len(part)] += 1
    mixed = op6_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(tuple(r) for r in mixed.collect()) == +expected
