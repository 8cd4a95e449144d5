"""A Merkle manifest of a table: one tree of digests for each language, and one over their roots.

Nodes are numbered from 0 in each tree.  A level is one self-join: every node asks for the siblings of
its run, whose numbers follow from its own (the run's begin and the slot shifted by 1 to 7), and an
equijoin on tree and number brings their digests.  The rows of slot 0, who then hold their whole run,
emit the parents.  Each level is written before the next one reads it twice, and is an eighth of it.

A node's step is what stands left and right of it in its run.  From the root down, a node's path is its
own step before its parent's path, joined on the parent's number.  A leaf's path is its proof: folding
any leaf's digest with it gives the root that this leaf would lead to.

Numbering.  Rows are dealt into ranges of tree and key and sorted there; a row's number is its place
in its range, plus the rows of its tree in earlier ranges, one figure for each range and tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.sources.scratch import discarded, new_folder, written

ARITY = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The tree over the trees' roots.
TOP = "root"


def digest(data: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def as_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def joined(parts: Column) -> Column:
    """An array of byte strings as one; null is empty."""
    return F.coalesce(F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x)), F.unhex(F.lit("")))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each value with its length in bytes before it, or ``-`` for null."""
    marked = [F.coalesce(F.concat(F.octet_length(f), F.lit(":"), f), F.lit("-")) for f in (c.cast("string") for c in fields)]
    return digest(F.concat(*marked))


def numbered(rows: DataFrame, tree: str, order: list[str], name: str, folder: str) -> DataFrame:
    """``rows``, written, with ``i``, the place in the own ``tree`` by ``order``, and ``n``, the tree's size."""
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id()), name, folder)
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("part", tree).agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "part",
        tree,
        (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("begin")).alias("shift"),
        F.sum("held").over(Window.partitionBy(tree)).alias("n"),
    )
    return placed.join(starts, ["part", tree]).withColumn("i", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``tree, i, n, run`` of the nodes whose tree has others: their whole run as ``(j, hash)``, in order."""
    several = nodes.select("tree", "i", "n", "hash").where("n > 1")
    slot = F.col("i") % ARITY
    shifted = F.transform(F.sequence(F.lit(1), F.lit(ARITY - 1)), lambda d: F.col("i") - slot + (slot + d) % ARITY)
    asking = several.select("tree", "i", F.explode(F.filter(shifted, lambda j: j < F.col("n"))).alias("j"))
    told = asking.join(several.select("tree", F.col("i").alias("j"), "hash"), ["tree", "j"])
    both = told.select("tree", "i", "j", "hash", F.lit(None).cast("long").alias("n"))
    both = both.unionByName(several.select("tree", "i", F.col("i").alias("j"), "hash", "n"))
    run = F.array_sort(F.collect_list(F.struct("j", "hash"))).alias("run")  # at most eight
    return both.groupBy("tree", "i").agg(F.max("n").alias("n"), run)


def parents(level: DataFrame) -> DataFrame:
    """The next level: ``tree, i, n, hash``, from the rows of slot 0."""
    data = as_hex(joined(F.transform("run", lambda x: x["hash"])))
    up = lambda c: F.ceil(F.col(c) / ARITY).cast("long")
    return level.where(F.col("i") % ARITY == 0).select("tree", up("i").alias("i"), up("n").alias("n"), digest(data).alias("hash"))


def grown(leaves: DataFrame, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels of all trees over ``tree, i, n, hash``, with siblings; and ``tree, hash`` of the roots."""
    levels, roots, nodes = [], [], leaves
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.where("n = 1").select("tree", "hash"))
        if most <= 1:
            break
        levels.append(written(with_siblings(nodes), "level", folder))
        nodes, most = written(parents(levels[-1]), "nodes", folder), -(-most // ARITY)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, found


def paths(leaves: DataFrame, levels: list[DataFrame], begun: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """``tree, i, path, root`` of every leaf: the steps from it to its tree's root, then the path of its tree.

    ``begun`` gives rows ``tree, i`` of roots their ``path`` and ``root``.  A step is the struct
    ``left, right`` of the digests beside a node in its run.
    """
    alone = begun(leaves.where("n = 1").select("tree", "i"))
    beside = lambda test: joined(F.transform(F.filter("run", test), lambda x: x["hash"]))
    below = None
    for k, level in enumerate(reversed(levels), 1):
        # the parents' paths, and those of the trees whose root is the only parent here
        up = begun(level.where(f"i = 0 AND n <= {ARITY}").select("tree", "i"))
        up = up if below is None else below.unionByName(up)
        step = F.struct(
            beside(lambda x: x["j"] < F.col("i")).alias("left"), beside(lambda x: x["j"] > F.col("i")).alias("right")
        )
        here = level.select("tree", "i", F.floor(F.col("i") / ARITY).alias("up"), step.alias("step"))
        below = here.join(up.withColumnRenamed("i", "up"), ["tree", "up"])
        below = below.select("tree", "i", F.concat(F.array("step"), "path").alias("path"), "root")
        if k < len(levels):  # an eighth of the leaves at most
            below = written(below, "paths", folder)
    return alone if below is None else below.unionByName(alone)


def folded(hash_: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to."""
    return F.aggregate(path, hash_, lambda h, s: digest(as_hex(F.concat(s["left"], h, s["right"]))))


def manifest(documents: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``documents``.

    A leaf is the digest of the columns ``FIELDS``; others are ignored.  Leaves of a language ascend by
    id, nulls first; equal ids by digest, so that rows which repeat are leaves of their own.  A null
    language is a tree too and comes first.  ``proof_sha256`` is the digest of the leaf's siblings
    up to the root.  ``folded_root`` starts at the leaf with the columns in ``tampered`` put in, in
    rows where ``where`` holds, else at the own one.  An empty table gives an empty result.
    """
    folder = new_folder(documents.sparkSession, "merkle")
    own = [F.col(c) for c in FIELDS]
    other = leaf([(tampered or {}).get(c, F.col(c)) for c in FIELDS])
    changed = F.when(F.coalesce(where, F.lit(False)) if where is not None else F.lit(bool(tampered)), other)
    rows = documents.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(own).alias("hash"),
        changed.alias("other"),
    )
    # texts are read once; all that follows is narrow
    rows = written(rows, "digests", folder)
    leaves = written(numbered(rows, "tree", ["doc_id", "hash"], "ordered", folder), "leaves", folder)
    levels, subroots = grown(leaves, folder)
    ranked = numbered(subroots.withColumnRenamed("tree", "key").withColumn("tree", F.lit(TOP)), "tree", ["key"], "subroots", folder)
    ranked = written(ranked, "ranked", folder)
    top_levels, root = grown(ranked, folder)
    found = root.first()
    root = F.lit(found["hash"] if found else None).cast("binary")
    no_steps = F.array().cast("array<struct<left:binary,right:binary>>")
    in_top = paths(ranked, top_levels, lambda t: t.withColumns({"path": no_steps, "root": root}), folder)
    tops = ranked.select(F.col("key").alias("tree"), "i", F.col("hash").alias("root")).join(in_top.select("i", "path"), "i")
    tops = written(tops.select("tree", "path", "root"), "tops", folder)
    joined_up = leaves.join(paths(leaves, levels, lambda t: t.join(tops, "tree"), folder), ["tree", "i"])
    proof = joined(F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    result = joined_up.select(
        "doc_id",
        as_hex(F.col("hash")).alias("leaf"),
        as_hex(F.col("root")).alias("subroot"),
        as_hex(root).alias("root"),  # of all trees
        F.sha2(as_hex(proof), 256).alias("proof_sha256"),
        as_hex(folded(F.coalesce("other", "hash"), F.col("path"))).alias("folded_root"),
    )
    result = written(result.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
    discarded(documents.sparkSession, folder)
    return result
