"""Token counts from flat token files: the files hold ids and end marks and no index.

A file is a run of blocks of equally many 16-bit ids; a document may span blocks.  Each block is
searched for end marks as one array, which gives the lengths of documents that begin and end in it
and what lies open at its edges.  A running sum over the blocks of a file then tells how many
ids of the first document of a block lie in earlier blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wardflow.llm.bpe import in_task, slices_encoded
from wardflow.llm.pretokens import RememberingEncoder
from wardflow.llm.words import releasing
from wardflow.sources.scratch import written

#: Ids of a block; a file's last one may be shorter.
BLOCK_IDS = 1 << 18
#: Stands after each document; free in the vocabularies of up to 50,256 tokens.
END_ID = 50256


def _packed(
    encode: RememberingEncoder, batches: Iterator[pa.RecordBatch], end_id: int, block: int
) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    names: list[int | None] = []
    size, number, file = 0, 0, 0

    def take(ids: np.ndarray) -> pa.RecordBatch:
        """The next block; it names the documents whose end mark it holds, in order."""
        done = int((ids == end_id).sum())
        row = [
            pa.array([file], pa.int32()),
            pa.array([number], pa.int32()),
            pa.array([ids.tobytes()], pa.binary()),
            pa.array([names[:done]], pa.list_(pa.int64())),
        ]
        del names[:done]
        return pa.RecordBatch.from_arrays(row, ["file", "block", "ids", "ended"])

    for part, _, texts in slices_encoded(batches, 1, encode):
        file = part.column(2)[0].as_py()
        names += part.column(0).to_pylist()
        for ids in texts:
            held.append(np.append(ids, np.uint32(end_id)).astype("<u2"))
            size += len(held[-1])
        if size >= block:
            flat = np.concatenate(held)
            whole = len(flat) // block * block
            for at in range(0, whole, block):
                yield take(flat[at : at + block])
                number += 1
            held, size = [flat[whole:].copy()], len(flat) - whole
    if size:
        yield take(np.concatenate(held))


def token_files(documents: DataFrame, ranks_path: str, end_id: int = END_ID, block: int = BLOCK_IDS) -> DataFrame:
    """``file, block, ids, ended``: all texts as flat files of packed 16-bit ids.

    A null text has no ids, only its end mark.  ``ended`` names the documents whose mark lies in
    the block; the scan pairs them with the marks it finds.  Rows that repeat an id are documents of their
    own, other columns are ignored, and an empty table has no blocks.  Ids that 16 bits can't hold, and an
    end mark that is a token of the rank file, are errors.
    """
    with open(ranks_path, "rb") as lines:
        highest = max((int(line.split()[1]) for line in lines), default=-1)
    if not highest < end_id <= 0xFFFF:
        raise ValueError(f"ids up to {highest} and the end mark {end_id} must differ and fit into 16 bits")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pack = in_task(lambda encode, batches: _packed(encode, batches, end_id, block), ranks_path)
    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(
        pack, "file int, block int, ids binary, ended array<long>"
    )


def _scanned(batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            ids = np.frombuffer(batch.column(2)[i].as_buffer(), "<u2")
            marks = np.flatnonzero(ids == end_id)
            lengths = np.diff(marks, prepend=-1) - 1
            found = {
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "n_ids": pa.array([len(ids)], pa.int64()),
                "n_marks": pa.array([len(marks)], pa.int64()),
                "open_ids": pa.array([len(ids) - (int(marks[-1]) + 1 if len(marks) else 0)], pa.int64()),
            }
            row = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), *found.values()], ["file", "block", *found])


def scanned(files: DataFrame, end_id: int = END_ID) -> DataFrame:
    """``file, block, lengths, carried``: the documents that end in each block, in order.

    ``lengths`` counts a document's ids inside the block; ``carried`` are those of the first one
    in earlier blocks.  Ids after a file's last end mark are no document.
    """
    blocks = files.select("file", "block", "ids").mapInArrow(
        releasing(lambda batches: _scanned(batches, end_id)),
        "file int, block int, lengths array<long>, n_ids long, n_marks long, open_ids long",
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.withColumn("end_at", F.sum("n_ids").over(upto)).withColumn(
        "mark_at", F.when(F.col("n_marks") > 0, F.col("end_at") - F.col("open_ids"))
    )
    carried = F.col("end_at") - F.col("n_ids") - F.coalesce(F.max("mark_at").over(earlier), F.lit(0))
    return placed.select("file", "block", "lengths", carried.alias("carried"))


def counts(files: DataFrame, end_id: int = END_ID) -> DataFrame:
    """``doc_id, n_tokens`` of every document in a table of token files, end marks not counted.

    An id that was written twice is counted twice, a row each; without blocks there is no row.
    """
    found = scanned(files, end_id)
    named = found.join(files.select("file", "block", "ended"), ["file", "block"])
    each = named.select("carried", F.posexplode(F.arrays_zip("ended", "lengths")).alias("place", "document"))
    first = F.when(F.col("place") == 0, F.col("carried")).otherwise(0)
    return each.select(F.col("document.ended").alias("doc_id"), (F.col("document.lengths") + first).alias("n_tokens"))


def written_and_counted(documents: DataFrame, ranks_path: str, end_id: int = END_ID) -> DataFrame:
    """The documents encoded to token files in the shared folder, and counted from these."""
    return counts(written(token_files(documents, ranks_path, end_id), "flat"), end_id)
