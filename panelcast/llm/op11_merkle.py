"""Merkle manifest of a table, climbed by a recursive query.

Every row is a leaf. Leaves of a source stand in the order of their keys; runs of sixteen nodes become
their parent until one is left, the source's subroot, and the subroots become the root the same way.
The levels are written as rows that name their parent. A recursive query then
climbs from every leaf at once: each step joins a row with its parent, appends the siblings beside it and
folds the hash so far into the parent's. What a changed row folds to is not the root.

A run is one binary column of at most sixteen digests, so siblings are two substrings of it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm import common

FAN = 16
DIGEST = 32
#: Levels that a node's number has room for: those of sources are below ``TOP``, those of their subroots begin there.
LEVELS = 32
TOP = 16
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def encoded(value: Column) -> Column:
    """A field inside a leaf: ``-`` for null, else its bytes with their number before."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Binary sha256 of text parts, one after another."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def folded(run: Column) -> Column:
    """The parent of a run of binary digests: the hash of their hexadecimal text."""
    return F.unhex(F.sha2(F.lower(F.hex(run)).cast("binary"), 256))


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed."""
    return F.translate(text, _UPPER, _UPPER.lower())


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``doc_id``, ``source``, ``leaf`` and ``changed``: the leaf of the row after ``tampered`` rows' texts are lowered.

    The text is hashed a second time only where that may matter.
    """
    def leaf(text: Column) -> Column:
        return digest(*[encoded(text if name == "text" else F.col(name)) for name in FIELDS])

    own = leaf(F.col("text"))
    changed = F.when(tampered, leaf(lowered(F.col("text")))).otherwise(F.col("leaf"))
    return docs.select(*FIELDS).withColumn("leaf", own).withColumn("changed", changed).select("doc_id", "source", "leaf", "changed")


def placed(rows: DataFrame, order: list[str], what: str) -> DataFrame:
    """Rows with ``part`` and ``rank``, their place from 0 in the order of the columns (nulls first), written once.

    Rows are dealt out by ranges of all columns of the order: a source or key with very many rows is
    spread over tasks. One row per task is summed up to know where its range begins.
    """
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    ranged = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = common.stored(ranged.select("*", F.spark_partition_id().alias("part"), place.alias("place")), what)
    parts = common.prefix_sums(held.groupBy("part").agg(F.count("*").alias("n")), "part", "n", "before").drop("n")
    return held.join(parts, "part").withColumn("rank", F.col("before") + F.col("place")).drop("before", "place")


def _number(tree: Column, place: Column, height: int, base: int) -> Column:
    """A node's number: the first leaf below it, and its level. ``height``: above the leaves of its tree."""
    return (tree + place * FAN**height) * LEVELS + F.lit(base + height)


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level of the trees that have several nodes on this one; ``size``: nodes of the tree on a level."""
    many = nodes.where("size > 1").withColumn("up", F.expr(f"place div {FAN}"))
    # At most sixteen rows meet in a group.
    ordered = F.sort_array(F.collect_list(F.struct("place", "digest")))
    runs = many.groupBy("tree", "up", "size").agg(ordered.alias("children"))
    run = F.unhex(F.array_join(F.transform("children", lambda c: F.hex(c["digest"])), ""))
    size = F.expr(f"(size + {FAN - 1}) div {FAN}").alias("size")
    return runs.select("tree", F.col("up").alias("place"), size, run.alias("run")).withColumn("digest", folded(F.col("run")))


def _links(height: int, base: int) -> list[Column]:
    """Parent and place in its run of a node that is not the last of its tree."""
    slot = F.col("place") % FAN
    parent = _number(F.col("tree"), F.expr(f"place div {FAN}"), height + 1, base)
    return [F.when(F.col("size") > 1, parent).alias("parent"), slot.cast("int").alias("slot")]


def _levels(bottom: DataFrame, base: int) -> list[DataFrame]:
    """Written levels above ``bottom``, up to the one where every tree has a single node."""
    found, below = [], bottom
    while (below.agg(F.max("size")).first()[0] or 0) > 1:
        height = len(found) + 1
        assert height < TOP
        level = common.stored(_parents(below), f"level{base + height}")
        number = _number(F.col("tree"), F.col("place"), height, base)
        found.append(level.select(number.alias("node"), *_links(height, base), "run", "digest", "tree", (F.col("size") == 1).alias("ends")))
        below = level.drop("run")
    return found


def build(docs: DataFrame, path: str, tampered: Column) -> None:
    """Write the manifest of ``docs``: ``path/leaves``, and ``path/nodes`` with the levels above them.

    A node has its number, its parent's, its place among the siblings (``slot``), the ``run`` of its children's
    digests, its own ``digest``, and says whether it is a subroot, and one of the lowest in its tree. ``tampered`` marks rows whose ``changed`` leaf
    is taken from the lowered text.

    Leaves of a source ascend by ``doc_id``, nulls first, ties by leaf; sources by their bytes, null first.
    Null and empty texts, repeated rows and repeated keys are leaves like others; columns that are not
    part of a leaf are not read. An empty table has neither leaves nor nodes.
    """
    spark = docs.sparkSession
    ranked = placed(leaves(docs, tampered), ["source", "doc_id", "leaf", "changed"], "leaves")
    # One row per source and range: where the source begins, and how many rows it has.
    blocks = ranked.groupBy("part", "source").agg(F.min("rank").alias("begin"), F.count("*").alias("n"))
    along = Window.partitionBy("source")
    blocks = blocks.select(
        F.col("part").alias("_part"),
        F.col("source").alias("_source"),
        F.min("begin").over(along).alias("tree"),
        F.sum("n").over(along).alias("size"),
    )
    same = (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = ranked.join(blocks, same).withColumn("place", F.col("rank") - F.col("tree"))
    rows = common.stored(rows.select("doc_id", "leaf", "changed", "rank", "tree", "place", "size"), "ranked")
    bottom = rows.select("tree", "place", "size", F.col("leaf").alias("digest"))
    own = _levels(bottom, 0)

    # The order of the sources is that of their first leaves.
    lone = bottom.where("size = 1").select("tree", "digest")
    ends = [level.where("ends").select("tree", "digest") for level in own]
    subroots = placed(reduce(DataFrame.unionByName, ends, lone), ["tree"], "subroots")
    size = F.lit(subroots.count()).cast("long").alias("size")
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("rank").alias("place"), size, "digest", F.col("tree").alias("_tree"))
    links = top.select("_tree", *_links(0, TOP))
    above = _levels(top.drop("_tree"), TOP)

    columns = ["node", "parent", "slot", "run", "digest"]
    parts = []
    for height, level in enumerate(own, 1):
        kept = [F.lit(height == 1).alias("lowest")]
        parts.append(level.where("not ends").select(*columns, F.lit(False).alias("subroot"), *kept))
        joined = level.where("ends").drop("parent", "slot").join(links, F.col("tree") == F.col("_tree"))
        parts.append(joined.select(*columns, F.lit(True).alias("subroot"), *kept))
    for height, level in enumerate(above, 1):
        parts.append(level.select(*columns, F.lit(False).alias("subroot"), F.lit(height == 1).alias("lowest")))
    if not parts:
        kinds = "node long, parent long, slot int, run binary, digest binary, subroot boolean, lowest boolean"
        parts = [spark.createDataFrame([], kinds)]
    reduce(DataFrame.unionByName, parts).write.option("compression", "zstd").parquet(f"{path}/nodes")

    columns = ["doc_id", "leaf", "changed", "rank", "parent", "slot"]
    many = rows.where("size > 1").select("*", *_links(0, 0)).select(*columns, F.lit(False).alias("lone"))
    single = rows.where("size = 1").join(links, F.col("tree") == F.col("_tree")).select(*columns, F.lit(True).alias("lone"))
    many.unionByName(single).write.option("compression", "zstd").parquet(f"{path}/leaves")


CLIMB = """
WITH RECURSIVE climb (leaf, node, up, slot, fold, siblings, subroot) AS (
    SELECT rank, node, parent, slot, changed, siblings, subroot FROM {leaves}
    UNION ALL
    SELECT c.leaf, c.node, n.parent, n.slot,
        CASE WHEN c.leaf IS NOT NULL THEN unhex(sha2(CAST(lower(hex(
            concat(substring(n.run, 1, {size} * c.slot), c.fold, substring(n.run, {size} * c.slot + {size} + 1))
        )) AS BINARY), 256)) END,
        concat(c.siblings, substring(n.run, 1, {size} * c.slot), substring(n.run, {size} * c.slot + {size} + 1)),
        CASE WHEN c.node IS NOT NULL THEN coalesce(c.subroot, CASE WHEN n.subroot THEN n.digest END) END
    FROM climb c JOIN {nodes} n ON c.up = n.node
)
SELECT leaf, node, fold, siblings, subroot FROM climb WHERE up IS NULL
"""


def climb(spark: SparkSession, path: str) -> DataFrame:
    """Where every leaf and every lowest run of leaves arrives at the root.

    Each step of a recursive query joins all climbers with their parents: a changed leaf is folded into its
    parent's run, a run appends the siblings beside it. What stands above a run is the same for its
    sixteen leaves, so the run carries it for them. The query's number of rows is
    not limited; it is run and written under a setting of its own.
    """
    names = {what: f"{what}_{uuid.uuid4().hex}" for what in ("leaves", "nodes")}
    nodes = spark.read.parquet(f"{path}/nodes")
    nodes.createOrReplaceTempView(names["nodes"])
    runs = nodes.where("lowest").select(
        F.lit(None).cast("long").alias("rank"), "node", "parent", "slot", F.lit(None).cast("binary").alias("changed"),
        F.lit(b"").alias("siblings"), F.when(F.col("subroot"), F.col("digest")).alias("subroot"),
    )
    leaves = spark.read.parquet(f"{path}/leaves").select("rank", "changed", "parent", "slot")
    leaves.unionByName(runs, allowMissingColumns=True).createOrReplaceTempView(names["leaves"])
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return common.stored(spark.sql(CLIMB.format(size=DIGEST, **names)), "climb")
    finally:
        spark.conf.set(ROW_LIMIT, before)
        for name in names.values():
            spark.catalog.dropTempView(name)


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """Per leaf: its digests and its proof, folded, and whether the changed leaf still leads to the root."""
    arrived = climb(spark, path)
    nodes, leaves = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/leaves")
    high = arrived.where("node is not null").select("node", "siblings", F.col("subroot").alias("above"))
    runs = nodes.where("lowest").select("node", "run").join(high, "node")
    folds = arrived.where("leaf is not null").select(F.col("leaf").alias("rank"), "fold")
    # One row: the node without a parent. A single leaf is its own subroot and root.
    root = nodes.where("parent is null").select(F.col("digest").alias("top"))
    rows = leaves.drop("changed").join(folds, "rank").join(runs, F.col("parent") == F.col("node"), "left")
    rows = rows.join(F.broadcast(root.limit(1)), F.lit(True), "left")
    beside = [F.expr(f"substring(run, 1, {DIGEST} * slot)"), F.expr(f"substring(run, {DIGEST} * slot + {DIGEST} + 1)")]
    proof = F.coalesce(F.concat(*beside, "siblings"), F.lit(b""))
    top = F.coalesce("top", "leaf")

    def text(value: Column) -> Column:
        return F.lower(F.hex(value))

    return rows.select(
        "doc_id",
        text(F.col("leaf")).alias("leaf"),
        text(F.when(F.col("lone"), F.col("leaf")).otherwise(F.col("above"))).alias("subroot"),
        text(top).alias("root"),
        F.sha2(text(proof).cast("binary"), 256).alias("proof_sha256"),
        text(F.col("fold")).alias("folded_root"),
        (F.col("fold") == top).alias("verified"),
    )


def fifth(key: str = "doc_id") -> Column:
    """Rows that the query tampers with: 5 divides the checksum of their key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_folder(spark, "merkle")
    build(common.table(spark, sf_dir, "documents"), path, fifth())
    return proofs(spark, path)


#: The same in DuckDB: checksums by a table of 256 remainders, levels and climbs as recursions over lists.
ORACLE = """
WITH RECURSIVE
remainders AS (
    SELECT list_transform(range(256), lambda i: list_reduce(
        list_prepend(i::UBIGINT, list_transform(range(8), lambda k: 0::UBIGINT)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t
),
rows_ AS (
    SELECT doc_id, source, lang, n_chars, text,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        coalesce(xor(list_reduce(
            list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 5 = 0, false) AS hit
    FROM documents, remainders
),
hashed AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(changed)::VARCHAR || ':' || changed, '-')) AS changed
    FROM (
        SELECT *, CASE WHEN hit THEN low ELSE text END AS changed,
            coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-')
            || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
            || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-')
            || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head
        FROM rows_
    )
),
leaves AS (
    SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id, doc_id, leaf, changed,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n
    FROM hashed
),
lv AS (
    SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
    FROM lv WHERE n > 1 GROUP BY tree, level, pos // 16, n
),
runs AS (
    SELECT tree, level, pos // 16 AS up, list(digest ORDER BY pos) AS ds FROM lv WHERE n > 1 GROUP BY tree, level, pos // 16
),
subroots AS (SELECT tree, digest FROM lv WHERE n = 1),
top AS (
    SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
    FROM top WHERE n > 1 GROUP BY level, pos // 16, n
),
top_runs AS (
    SELECT level, pos // 16 AS up, list(digest ORDER BY pos) AS ds FROM top WHERE n > 1 GROUP BY level, pos // 16
),
low_climb AS (
    SELECT id, tree, 0 AS level, pos, n, changed AS fold, '' AS proof FROM leaves
    UNION ALL
    SELECT id, c.tree, c.level + 1, pos // 16, (n + 15) // 16,
        sha256(array_to_string(list_concat(ds[1:pos % 16], [fold], ds[pos % 16 + 2:]), '')),
        proof || array_to_string(list_concat(ds[1:pos % 16], ds[pos % 16 + 2:]), '')
    FROM low_climb c JOIN runs r ON c.tree = r.tree AND c.level = r.level AND c.pos // 16 = r.up
    WHERE n > 1
),
high_climb AS (
    SELECT id, 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, fold, proof FROM low_climb WHERE n = 1
    UNION ALL
    SELECT id, c.level + 1, pos // 16, (n + 15) // 16,
        sha256(array_to_string(list_concat(ds[1:pos % 16], [fold], ds[pos % 16 + 2:]), '')),
        proof || array_to_string(list_concat(ds[1:pos % 16], ds[pos % 16 + 2:]), '')
    FROM high_climb c JOIN top_runs r ON c.level = r.level AND c.pos // 16 = r.up
    WHERE n > 1
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(h.proof) AS proof_sha256,
    h.fold AS folded_root, h.fold = t.digest AS verified
FROM high_climb h JOIN leaves l USING (id) JOIN subroots s ON s.tree = l.tree, (SELECT digest FROM top WHERE n = 1) t
WHERE h.n = 1
"""
