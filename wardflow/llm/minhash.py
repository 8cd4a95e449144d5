"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Signature.  A document's set holds a 64-bit hash of every 5-word shingle.  A first permutation
sends each member to a place on a circle of 2**32; a second one, shifted by k places, gives the
k-th coordinate as its minimum over the set.  Two permutations thus make all coordinates.

Candidates.  Six coordinates make a band; documents that share one of the 64 bands meet in a
bucket.  At a similarity of 0.75 a pair shares fewer than two bands with a probability of 5e-5.

Large groups.  Documents with equal sets are one node from the start.  A bucket's members are
compared with its smallest id, never all with all, and what verifies is contracted to components.
Where a bucket's members are still in different components, a pivot decides which of them can be
linked: the node with the most links of the bucket's commonest component.  Two sets can't be
similar enough unless (A) both share enough members with the pivot, or (B) they share a member
that the pivot doesn't have.  Pairs of kind A are few, since what is that near the pivot is linked
with it, but for sizes.  For B it is enough to look at the first quarter of each set's
members outside the pivot, in the order of their hashes; pairs meet by such a member and need two
common bands.  So no bucket is capped, and no link between texts that share two bands is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardflow.llm.components import components
from wardflow.llm.words import Slice, mix64, releasing, slices, windows
from wardflow.sources.scratch import discarded, new_folder, written

SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 64, 6
#: Similarity in hundredths from which two documents are linked.
SIMILARITY = 75


def shingle_sets(part: Slice) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a short text's words are one shingle."""
    words = part.word_hashes(lower=True)
    hashes, at = windows(words, part.word_text, SHINGLE_WORDS)
    cuts = np.searchsorted(at, part.word_from)
    sets = []
    for i in range(len(part)):
        a, b = part.word_from[i], part.word_from[i + 1]
        if b - a >= SHINGLE_WORDS:
            sets.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
        else:
            sets.append(windows(words[a:b], part.word_text[a:b], b - a)[0] if b > a else hashes[:0])
    return sets


def _second_permutation(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 32-bit numbers."""
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int = BANDS * BAND_ROWS) -> np.ndarray:
    """One row of ``size`` 32-bit minima for each set; sets must not be empty."""
    starts = np.cumsum([0, *map(len, sets)])
    # the first permutation: one mix of the hash, cut to the circle of 2**32 places
    places = (mix64(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), size), np.uint32)
    step = 1 << 16
    cuts = [0]  # runs of whole sets of about ``step`` members: they stay in the processor's cache
    for i in range(1, len(sets) + 1):
        if i == len(sets) or starts[i + 1] - starts[cuts[-1]] > step:
            cuts.append(i)
    for a, b in zip(cuts, cuts[1:], strict=False):
        block, at = places[starts[a] : starts[b]], starts[a:b] - starts[a]
        for k in range(size):
            out[a:b, k] = np.minimum.reduceat(_second_permutation(block - np.uint32(k)), at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for j in range(BAND_ROWS):
        key = mix64(key * np.uint64(0x100000001B3) ^ rows[:, :, j])
    return key.astype(np.int64)


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch["text"]):
            sets = shingle_sets(part)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if full:
                for i, keys in zip(full, band_keys(signatures([sets[i] for i in full])), strict=True):
                    bands[i] = keys
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].iloc[part.begin : part.begin + len(part)].array,
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets],
                    "bands": bands,
                }
            )


def _with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch["text"]):
            ids = batch["doc_id"].iloc[part.begin : part.begin + len(part)].array
            yield pd.DataFrame({"id": ids, "members": [s.view(np.int64) for s in shingle_sets(part)]})


def described(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands`` of every row; no key and no bands for an empty set."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        releasing(_described), "doc_id long, n_shingles long, set_key binary, bands array<long>"
    )


def _sets_of(documents: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """``id, members`` of the documents whose id is in ``ids``."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    needed = texts.join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return written(needed.mapInPandas(releasing(_with_sets), "id long, members array<long>"), "sets", folder)


def _with_members(rows: DataFrame, sets: DataFrame, at: str) -> DataFrame:
    return rows.join(sets.select(F.col("id").alias(at), F.col("members").alias(f"of_{at}")), at)


def _may_be_similar(n: str, m: str):
    return 100 * F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def _verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, folder: str) -> DataFrame:
    """The pairs ``(u, v)`` whose whole sets are similar enough."""
    size = lambda c: sizes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    near = pairs.where("u <> v").distinct().join(size("u"), "u").join(size("v"), "v")
    near = near.where(_may_be_similar("n_u", "n_v")).select("u", "v")
    both = F.size(F.array_intersect("of_u", "of_v"))
    joined = _with_members(_with_members(near, sets, "u"), sets, "v")
    similar = joined.where(100 * both >= SIMILARITY * (F.size("of_u") + F.size("of_v") - both))
    return written(similar.select("u", "v"), "verified", folder)


def _labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with column ``c``: the component of ``id``."""
    of = groups.select(F.col("u").alias("id"), F.col("v").alias("c"))
    return rows.join(of, "id", "left").withColumn("c", F.coalesce("c", "id"))


def _pivots(members: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """``b, pivot, pivot_c`` of the buckets whose members are in more than one component."""
    ends = links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    hubs = _labelled(ends, groups).groupBy("c").agg((-F.max(F.struct("n", (-F.col("id")).alias("i")))["i"]).alias("hub"))
    parts = members.groupBy("b", "c").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("b").agg(F.count("*").alias("parts"), F.max(F.struct("n", (-F.col("c")).alias("i"))).alias("most"))
    commonest = mixed.where("parts > 1").select("b", (-F.col("most.i")).alias("c"))
    return commonest.join(hubs, "c", "left").select("b", F.coalesce("hub", "c").alias("pivot"), F.col("c").alias("pivot_c"))


def _pairs_across(members: DataFrame, pivots: DataFrame, known: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """``u, v``: what may be linked among members of one bucket in different components."""
    apart = members.join(pivots, "b").select("id", "c", "pivot", "pivot_c").distinct()
    beside = _with_members(_with_members(apart, sets, "id"), sets, "pivot")
    outside = F.array_sort(F.array_except("of_id", "of_pivot"))
    seen = written(
        beside.select(
            "id",
            "c",
            "pivot",
            "pivot_c",
            F.size("of_id").alias("n"),
            (F.size("of_id") - F.size(outside)).alias("a"),
            F.slice(outside, 1, F.floor(F.size("of_id") * (100 - SIMILARITY) / 100).cast("int") + 1).alias("head"),
        ),
        "seen",
        folder,
    )
    # one side is outside the pivot's component; if both are, the smaller id comes first
    differ = (F.col("c") != F.col("c2")) & ((F.col("c2") == F.col("pivot_c")) | (F.col("id") < F.col("id2")))
    differ &= _may_be_similar("n", "n2")
    out = F.col("c") != F.col("pivot_c")
    near = seen.where(100 * F.col("a") >= SIMILARITY * F.col("n")).drop("head")
    near_too = near.select("pivot", F.col("a").alias("a2"), *(F.col(c).alias(f"{c}2") for c in ("id", "c", "n")))
    enough = (100 + SIMILARITY) * F.least("a", "a2") >= SIMILARITY * (F.col("n") + F.col("n2"))
    kind_a = near.where(out).join(near_too, "pivot").where(differ & enough)
    by_member = seen.select("id", "c", "pivot", "pivot_c", "n", F.explode("head").alias("s"))
    # members that one component alone has bring no pair about
    shared = by_member.groupBy("pivot", "s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    by_member = by_member.join(shared.select("pivot", "s"), ["pivot", "s"], "left_semi")
    by_member = written(by_member.join(known.select("id", "bands"), "id"), "heads", folder)
    by_other = by_member.select("pivot", "s", *(F.col(c).alias(f"{c}2") for c in ("id", "c", "n", "bands")))
    two_bands = F.size(F.array_intersect("bands", "bands2")) >= 2
    kind_b = by_member.where(out).join(by_other, ["pivot", "s"]).where(differ & two_bands)
    pairs = [k.select(F.col("id").alias("u"), F.col("id2").alias("v")) for k in (kind_a, kind_b)]
    return pairs[0].unionByName(pairs[1]).distinct()


def near_duplicate_groups(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``documents``.

    Needs columns ``doc_id`` and ``text``; others are ignored.  A null or wordless text has an
    empty set and is linked with nothing.  Rows without ``doc_id`` are in no group and kept, with
    a null ``component_id``.  Rows that repeat a ``doc_id`` are placed each by its own text; with one
    text they are one document.  An empty table gives an empty result.
    """
    spark = documents.sparkSession
    folder = new_folder(spark, "near")
    rows = written(described(documents), "described")
    copies = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = written(copies.groupBy("set_key").agg(F.min("doc_id").alias("id")), "nodes")
    first = nodes.select(F.col("id").alias("doc_id"), "set_key")
    known = copies.join(first, ["doc_id", "set_key"], "left_semi")
    known = written(known.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands"), "known", folder)
    sizes = known.groupBy("id").agg(F.max("n").alias("n"))
    in_bucket = known.select("id", F.explode("bands").alias("b"))
    # every member with the smallest one of its bucket
    least = in_bucket.groupBy("b").agg(F.min("id").alias("low"), F.count("*").alias("size")).where("size > 1")
    shared = written(in_bucket.join(least.select("b", "low"), "b"), "buckets", folder)
    # the whole sets of all documents that share a bucket, once for all comparisons
    sets = _sets_of(documents, shared.select("id"), folder)
    stars = shared.select(F.col("low").alias("u"), F.col("id").alias("v"))
    links = _verified(stars, sets, sizes, folder)
    groups = components(links, folder)
    members = _labelled(shared.select("id", "b"), groups)
    pairs = _pairs_across(members, _pivots(members, links, groups), known, sets, folder)
    more = _verified(pairs, sets, sizes, folder)
    groups = written(components(groups.unionByName(more), folder), "groups")
    discarded(spark, folder)
    of_set = _labelled(nodes, groups).select("set_key", F.col("c").alias("component_id"))
    return (
        rows.join(of_set, "set_key", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
