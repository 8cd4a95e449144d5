import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa

from tests.llm.odd import ROWS, documents
from wardflow.llm import content_sort


def by_brute_force(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and how many each group keeps."""
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known, default=None), len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check(spark, rows):
    found = content_sort.exact_groups(documents(spark, rows)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "text_sha256")) for r in found), key=str) == by_brute_force(rows)
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in found}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_odd_rows(spark):
    check(spark, ROWS)
    assert content_sort.exact_groups(documents(spark, []).limit(0)).count() == 0


def test_groups_across_ranges(spark):
    rng = random.Random(3)
    head = "the same beginning of every text " * 20
    rows = [(i, head + "end", "s") for i in range(1500)]  # one group over several ranges
    rows += [(2000 + i, head + "end \t" * (i % 3 + 1) + str(i % 40), "s") for i in range(600)]
    rows += [(i, "another", "s") for i in (9, 9, 9, None, None)]
    rows += [(None, "nobody's", "s")] * 2
    rng.shuffle(rows)
    check(spark, rows)


def test_runs_over_batches():
    rows = [(i, t) for i, t in enumerate("aaaabbcddddddde")]
    want = {"a": (0, 4), "b": (4, 2), "c": (6, 1), "d": (7, 7), "e": (14, 1)}
    for step in (1, 2, 3, 5, 20):
        batches = [
            pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in some], "text_sha256": [t for _, t in some], "body": [t.encode() for _, t in some]})
            for some in (rows[at : at + step] for at in range(0, len(rows), step))
        ]
        found = pa.Table.from_batches(content_sort._runs(iter(batches))).to_pylist()
        assert [(r["doc_id"], r["text_sha256"]) for r in found] == rows
        assert all((r["keep_id"], r["group_size"]) == want[r["text_sha256"]] for r in found)
        assert [r["text_sha256"] for r in found if r["first"]] == list("abcde")
        assert {r["text_sha256"] for r in found if r["edge"]} == {"a", "e"}
