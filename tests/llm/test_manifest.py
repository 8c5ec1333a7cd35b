"""The Merkle manifest against plain Python and SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import check
from panelcast.llm import op11_merkle

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return sha("".join(field(v) for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return found


def manifest(rows):
    """Rows of the result, sorted."""
    sources = {}
    for row in rows:
        sources.setdefault(row.source, []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for own in sources.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: levels([leaf(r, r.text) for r in sources[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    found = []
    for place, source in enumerate(order):
        for i, row in enumerate(sources[source]):
            hit = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 5 == 0
            own = leaf(row, row.text)
            fold, proof = leaf(row, lowered(row.text)) if hit else own, ""
            for tree, at in ((trees[source], i), (top, place)):
                for level in tree[:-1]:
                    first = at // 16 * 16
                    run = level[first : first + 16]
                    proof += "".join(run[: at - first] + run[at - first + 1 :])
                    run[at - first] = fold
                    fold, at = sha("".join(run)), at // 16
            root = top[-1][0]
            found.append((row.doc_id, own, trees[source][-1][0], root, sha(proof), fold, fold == root))
    return sorted(found, key=str)


def test_edge_cases(edge, spark, sf_of):
    """Nulls, equal rows, sources with one row and without name, clashing names of extra columns."""
    rows = op11_merkle.query(spark, sf_of(documents=edge)).collect()
    assert sorted(map(tuple, rows), key=str) == manifest(edge.collect())


@pytest.mark.parametrize(("sources", "n"), [(1, 1), (1, 16), (1, 17), (3, 300), (300, 300), (40, 600)])
def test_shapes_of_trees(spark, sf_of, sources, n):
    """One leaf, full and overfull runs, many sources (subroots with levels of their own)."""
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("Text "), "id").alias("text"),
        F.lit("en").alias("lang"),
        F.concat(F.lit("s"), F.col("id") % sources).alias("source"),
        F.length(F.col("id").cast("string")).cast("long").alias("n_chars"),
    )
    rows = op11_merkle.query(spark, sf_of(documents=docs)).collect()
    assert sorted(map(tuple, rows), key=str) == manifest(docs.collect())


def test_texts_change_or_not(spark, sf_of):
    """Only A-Z are lowered: other letters stay, so such a text is verified although it was touched."""
    hit = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(hit, "ÄÉ 12 straße " * 50_000, "de", "a", None), (hit + 1000, "X", "de", "a", 1)], schema)
    rows = {r.doc_id: r for r in op11_merkle.query(spark, sf_of(documents=docs)).collect()}
    assert rows[hit].verified
    assert sorted(map(tuple, rows.values()), key=str) == manifest(docs.collect())


def test_empty_table(nothing, spark, sf_of):
    assert op11_merkle.query(spark, sf_of(documents=nothing)).collect() == []


def test_setting_of_the_session_is_kept(spark):
    before = spark.conf.get(op11_merkle.ROW_LIMIT)
    op11_merkle.query(spark, SF).count()
    assert spark.conf.get(op11_merkle.ROW_LIMIT) == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("leaves_", "nodes_"))]


def test_stored_nodes_name_their_parents(spark, edge, tmp_path):
    op11_merkle.build(edge, str(tmp_path), op11_merkle.fifth())
    nodes = {r.node: r for r in spark.read.parquet(f"{tmp_path}/nodes").collect()}
    assert sum(r.parent is None for r in nodes.values()) == 1 and all(r.lowest for r in nodes.values())
    assert all(bytes(nodes[r.parent].run)[32 * r.slot : 32 * r.slot + 32] == bytes(r.digest) for r in nodes.values() if r.parent is not None)


def test_sql(spark):
    assert check.difference(op11_merkle.query(spark, SF), check.connect(SF), op11_merkle.ORACLE) is None
