"""Exact duplicates by a sort of the texts' bytes.

Texts are normalised: every run of space and 0x09-0x0D is one space.  Rows are dealt into ranges by
splitters that Spark samples, and sorted inside each range, spilling as needed.  The sort key is the
text's first bytes, the digest of all of it, the whole text and the id; the splitters consist of the
first, second and last of these, so that what the driver samples is a few dozen bytes a row however
long the texts are, and copies without number are cut into ranges by their ids.

Equal texts are neighbours then.  One pass over a range compares each text with the one before, byte
for byte, and a run of equal ones is a group; its first row has the smallest id.  Only a range's first
and last run can go on in another range: these, two rows for each range, are folded by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from wardflow.sources.scratch import written

#: Bytes of a text that splitters see before its digest.
HEAD_BYTES = 64

RUNS = "doc_id long, text_sha256 string, keep_id long, group_size long, first boolean, edge boolean, part int"


def normalised(text: Column) -> Column:
    """The text with one space for each run of space and 0x09-0x0D; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_sorted(documents: DataFrame) -> DataFrame:
    """``doc_id, text_sha256, body`` in ranges, each sorted by content and id (null ids last)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"))
    keyed = rows.select(
        "doc_id",
        F.sha2("body", 256).alias("text_sha256"),
        F.substring(F.col("body").cast("binary"), 1, HEAD_BYTES).alias("head"),
        F.col("body").cast("binary").alias("body"),
    )
    last = F.col("doc_id").asc_nulls_last()
    return keyed.repartitionByRange("head", "text_sha256", last).sortWithinPartitions("head", "text_sha256", "body", last).drop("head")


class _Runs:
    """Groups of equal neighbours in one sorted range; the rows of the last run wait for its end."""

    def __init__(self):
        self.part = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.body: bytes | None = None
        self.open: list[pa.RecordBatch] = []
        self.begun = False

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        body = batch.column("body")
        new = np.ones(len(body), bool)
        if len(body) > 1:
            new[1:] = ~pc.equal(body.slice(1), body.slice(0, len(body) - 1)).to_numpy(zero_copy_only=False)
        new[0] = body[0].as_py() != self.body
        self.body = body[len(body) - 1].as_py()
        narrow = batch.select(["doc_id", "text_sha256"])
        starts = np.flatnonzero(new)
        if not len(starts):
            self.open.append(narrow)
            return
        if starts[0]:
            self.open.append(narrow.slice(0, starts[0]))
        if self.open:
            yield self.close(edge=not self.begun)
        inner = narrow.slice(starts[0], starts[-1] - starts[0])
        if len(inner):
            yield self.described(inner, starts[:-1] - starts[0], edge=not self.begun)
        self.open = [narrow.slice(starts[-1])]

    def close(self, edge: bool) -> pa.RecordBatch:
        run = pa.Table.from_batches(self.open).combine_chunks().to_batches()[0]
        return self.described(run, np.zeros(1, np.int64), edge)

    def described(self, rows: pa.RecordBatch, starts: np.ndarray, edge: bool) -> pa.RecordBatch:
        """``rows`` with their runs, which begin at ``starts``; ``edge`` says that of the first run."""
        self.begun = True
        sizes = np.diff(np.append(starts, len(rows)))
        first = np.zeros(len(rows), bool)
        first[starts] = True
        at_edge = np.zeros(len(rows), bool)
        at_edge[: sizes[0]] = edge
        columns = [
            rows.column("doc_id"),
            rows.column("text_sha256"),
            rows.column("doc_id").take(pa.array(np.repeat(starts, sizes))),
            pa.array(np.repeat(sizes, sizes)),
            pa.array(first),
            pa.array(at_edge),
            pa.array(np.full(len(rows), self.part, np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in RUNS.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = _Runs()
    for batch in batches:
        if len(batch):
            yield from runs.add(batch)
    if runs.open:
        yield runs.close(edge=True)


def exact_groups(documents: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``documents``.

    Needs columns ``doc_id`` and ``text``; others are ignored.  A null text is empty, and a text of
    spaces alone is one space.  ``keep_id`` is the group's smallest id; of rows that repeat it, one
    is kept.  Rows without an id come last: one is kept if its group has no id at all, with a null
    ``keep_id``.  An empty table gives an empty result.
    """
    rows = written(content_sorted(documents).mapInArrow(_runs, RUNS), "runs")
    # at most two rows for each range
    ends = rows.where("edge AND first").groupBy("text_sha256")
    ends = ends.agg(F.min("keep_id").alias("k"), F.sum("group_size").alias("n"), F.min("part").alias("p"))
    ends = F.broadcast(ends.withColumnRenamed("text_sha256", "d"))
    found = rows.join(ends, F.col("edge") & (F.col("text_sha256") == F.col("d")), "left")
    return found.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("keep_id")).otherwise(F.col("k")).alias("keep_id"),
        F.coalesce("n", "group_size").alias("group_size"),
        (F.col("first") & (F.col("part") == F.coalesce("p", "part"))).alias("kept"),
        "text_sha256",
    )
