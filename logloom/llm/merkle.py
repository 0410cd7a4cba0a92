"""A Merkle manifest of a dataset: one tree per group of rows, and one tree over the groups' roots.

Slot pivot: on every level the children of a parent are spread into `fanout` columns by conditional
aggregates. The columns concatenated are what the parent hashes; the columns without a row's own slot
are its siblings. Proofs go down the same rows: a parent's row, joined with the path above it, gives the
paths of all its children, so the tables of rows are never joined level by level.

A level with one node in a tree is passed on as it is, so all trees have the height of the largest one
and low trees add no step to a path.

Positions come from `ranks.placed`, so a group with a third of all rows is not numbered in one task, and
parents are spread by (group, number). Each level is stored before the next one reads it; levels shrink
by the fanout. The driver gets one number per tree set, the largest width.

Defined results: a null in a hashed column counts as `-`; a null group is a group of its own and comes
first; rows with the same order value keep all copies, ordered by leaf; a null order value comes first; an
empty table has no rows and no root; a group with one row has that row's leaf as its root; texts of any
length are hashed whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.ranks import placed
from logloom.session import cut_lineage

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' concatenation; nulls add nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def framed(value: Column) -> Column:
    """UTF-8 byte count, colon and value, so that neighbours cannot run into each other; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return digest(*[framed(v) for v in values])


@dataclass(frozen=True)
class Forest:
    """Trees of equal height. `levels[k]` has a row per parent of level k: tree, place, width (nodes of that
    tree on level k), s0..s15 (children, hash first). `tops` has a row per tree: tree, hash."""

    levels: list[DataFrame]
    tops: DataFrame
    fanout: int


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """Children of each parent, spread into slot columns."""
    slot = F.col("place") % fanout
    child = F.struct(*[c for c in nodes.columns if c not in ("tree", "place", "width")])
    slots = [F.max(F.when(slot == i, child)).alias(f"s{i}") for i in range(fanout)]
    return nodes.groupBy("tree", F.floor(F.col("place") / fanout).cast("bigint").alias("parent")).agg(
        F.max("width").alias("width"), *slots).withColumnRenamed("parent", "place")


def _hashes(fanout: int) -> list[Column]:
    return [F.col(f"s{i}.hash") for i in range(fanout)]


def grow(leaves: DataFrame, fanout: int = FANOUT) -> Forest:
    """Trees over rows of (tree, place, width, hash, ...); further columns ride in the slots of level 0."""
    widest = leaves.agg(F.max("width")).first()[0] or 1
    levels, nodes = [], leaves
    while True:
        level = cut_lineage(_pivot(nodes, fanout))
        levels.append(level)
        # a tree of one node has ended: its node goes up unchanged
        up = F.when(F.col("width") == 1, F.col("s0.hash")).otherwise(digest(*_hashes(fanout)))
        nodes = level.select("tree", "place", F.ceil(F.col("width") / fanout).cast("bigint").alias("width"), up.alias("hash"))
        widest = -(-widest // fanout)
        if widest == 1:
            return Forest(levels, nodes.select("tree", "hash"), fanout)


def paths(forest: Forest, above: DataFrame) -> DataFrame:
    """One row per leaf: the fields of its slot, the steps from it upward, and what `above` has for its tree.

    `above` has `tree`, `steps` (from the tree's root on) and any further columns; steps are (left, right):
    the siblings' digests before and behind the own slot, concatenated.
    """
    carried = [c for c in above.columns if c not in ("tree", "steps")]
    top, fanout = above.withColumn("place", F.lit(0).cast("bigint")), forest.fanout
    hashes = _hashes(fanout)
    for number, level in reversed(list(enumerate(forest.levels))):
        joined = level.join(top, ["tree", "place"])
        slots = F.array(*[
            F.struct(
                F.lit(i).alias("slot"), F.col(f"s{i}").alias("child"),
                F.struct(F.concat_ws("", *hashes[:i]).alias("left"), F.concat_ws("", *hashes[i + 1:]).alias("right")).alias("step"),
            ) for i in range(fanout)])
        rows = joined.select(
            "tree", "place", "width", "steps", *carried, F.inline(F.filter(slots, lambda s: s["child"].isNotNull())))
        # the own step comes first; a tree that has ended adds none
        steps = F.when(F.col("width") == 1, F.col("steps")).otherwise(F.concat(F.array("step"), F.col("steps")))
        inner = ["child.*"] if number == 0 else []
        top = rows.select(
            "tree", (F.col("place") * fanout + F.col("slot")).alias("place"), steps.alias("steps"), *carried, *inner)
    return top


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, from the leaf's level to the root."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(rows: DataFrame, tree: str, order: str, leaf: Column, carry: dict[str, Column] | None = None,
             fanout: int = FANOUT) -> DataFrame:
    """Every row's leaf with its proof: `tree` value, `place`, `hash`, columns of `carry`, `steps`, `subroot`, `root`.

    Leaves ascend by `order` inside a tree; the trees' roots, ordered by the tree's value (null first, by
    UTF-8 bytes), are the leaves of the last tree.
    """
    slim = rows.select(
        F.col(tree).alias("tree"), F.col(order).alias("at"), leaf.alias("hash"),
        *[c.alias(n) for n, c in (carry or {}).items()])
    # the struct is never null and equals itself, so a null group joins like any other
    named = placed(slim, ["tree"], [F.col("at"), F.col("hash")]).withColumn("tree", F.struct("tree")).drop("at")
    forest = grow(named, fanout)
    groups = forest.tops.select(F.lit(0).alias("tree"), F.col("tree.tree").alias("name"), "hash")
    over = grow(placed(groups, ["tree"], [F.col("name")]), fanout)
    root = over.tops.select("tree", F.col("hash").alias("root"), F.array().cast(
        "array<struct<left:string,right:string>>").alias("steps"))
    subroots = paths(over, root).select(F.struct(F.col("name").alias("tree")).alias("tree"), "steps", F.col("hash").alias("subroot"), "root")
    return paths(forest, subroots).withColumn("tree", F.col("tree.tree"))


def document_manifest(documents: DataFrame) -> DataFrame:
    """Leaves and proofs of `documents`, one tree per source, with the leaf after the test tampering.

    Columns: doc_id, source, place, leaf, forged (null where the row is not tampered with), steps, subroot, root.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    forged = F.when(chosen, leaf_hash(*fields, F.translate(text, UPPER, LOWER)))
    found = manifest(documents, "source", "doc_id", leaf_hash(*fields, text), {"doc_id": F.col("doc_id"), "forged": forged})
    return found.withColumnsRenamed({"tree": "source", "hash": "leaf"})


def audit(found: DataFrame) -> DataFrame:
    """Each row's proof recomputed: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    folded = fold(F.coalesce("forged", "leaf"), F.col("steps"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(source_levels: int = 6, root_levels: int = 4) -> str:
    """DuckDB SQL for `audit(document_manifest(documents))`; trees of up to 16 ** levels leaves."""
    value = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    head = " || ".join(value.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    # CRC-32, bit by bit: the text's bytes enter at every eighth step
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * strlen(d)),"
        " lambda i: CASE WHEN i % 8 = 0 THEN ord(d[CAST(i // 8 AS INTEGER) + 1])::BIGINT ELSE 0::BIGINT END)),"
        " lambda c, e: xor(xor(c, e) >> 1, CASE WHEN xor(c, e) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))")
    parts = [
        f"hashed AS (SELECT doc_id, source, sha256({head} || {value.format('text')}) AS leaf,"
        f" sha256({head} || {value.format(lowered)}) AS forged, CAST(doc_id AS VARCHAR) AS d FROM documents)",
        f"a0 AS MATERIALIZED (SELECT doc_id, leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN forged ELSE leaf END AS claimed,"
        " coalesce('s' || source, '') AS tree, row_number() OVER w - 1 AS place, leaf AS hash, count(*) OVER (PARTITION BY source) AS width"
        " FROM hashed WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf))",
    ]

    def climb(name: str, levels: int) -> None:
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT tree, place // 16 AS place, CASE WHEN max(width) = 1 THEN max(hash)"
                f" ELSE sha256(string_agg(hash, '' ORDER BY place)) END AS hash, (max(width) + 15) // 16 AS width FROM {name}{k} GROUP BY ALL)"
                .replace("GROUP BY ALL", "GROUP BY tree, place // 16"))

    def sides(name: str, levels: int) -> None:
        """Left and right siblings of every node, beside it."""
        for k in range(levels):
            run = "PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN"
            parts.append(
                f"{name}s{k} AS MATERIALIZED (SELECT tree, place, width, coalesce(string_agg(hash, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                f" coalesce(string_agg(hash, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")

    climb("a", source_levels)
    parts.append(
        f"b0 AS MATERIALIZED (SELECT tree AS name, 0 AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, hash, count(*) OVER () AS width FROM a{source_levels})")
    climb("b", root_levels)
    sides("a", source_levels)
    sides("b", root_levels)
    folded, proof, joins = "x.claimed", [], []
    for k in range(source_levels):
        joins.append(f"JOIN as{k} ON as{k}.tree = x.tree AND as{k}.place = x.place // {16 ** k}")
    joins.append("JOIN b0 ON b0.name = x.tree")
    for k in range(root_levels):
        joins.append(f"JOIN bs{k} ON bs{k}.place = b0.place // {16 ** k}")
    steps = [f"as{k}" for k in range(source_levels)] + [f"bs{k}" for k in range(root_levels)]
    # folds are nested through a chain of tables, so no expression doubles
    parts.append(
        f"f0 AS MATERIALIZED (SELECT x.doc_id, x.leaf, b0.hash AS subroot, b{root_levels}.hash AS root, {folded} AS h, "
        + ", ".join(f"{s}.l AS l{n}, {s}.r AS r{n}, {s}.width AS w{n}" for n, s in enumerate(steps))
        + f" FROM a0 x {' '.join(joins)} CROSS JOIN b{root_levels})")
    for n in range(len(steps)):
        parts.append(f"f{n + 1} AS (SELECT * REPLACE (CASE WHEN w{n} = 1 THEN h ELSE sha256(l{n} || h || r{n}) END AS h) FROM f{n})")
        proof.append(f"l{n} || r{n}")
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256({' || '.join(proof)}) AS proof_sha256, h AS folded_root,"
        f" h = root AS verified FROM f{len(steps)}")
