import hashlib

from pyspark.sql import functions as F

from wardflow.llm import chat

EVENTS = "conv_id long, seq long, event string, message_id string, role string, text string"


def told(spark, rows):
    messages = chat.final_messages(spark.createDataFrame(rows, EVENTS)).collect()
    return [(r["role"], r["text"]) for r in sorted(messages, key=lambda r: (r["conv_id"] or 0, r["opened"]))]


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "message", "u1", "user", "hi"),
        (1, 1, "message", "a1", "assistant", ""),
        (1, 3, "delta", "a1", None, " there"),
        (1, 2, "delta", "a1", None, "hello"),
        (1, 4, "message", "u2", "user", "more"),
        (1, 5, "message", "a2", "assistant", "sure"),
        (1, 6, "edit", "u1", None, "hi!"),
    ]
    assert told(spark, log) == [("user", "hi!"), ("assistant", "hello there"), ("user", "more"), ("assistant", "sure")]
    log += [
        (1, 7, "regenerate", "a1", None, None),
        (1, 8, "delta", "a1", None, "good day"),
        (1, 9, "message", "u3", "user", "bye"),
    ]
    assert told(spark, log) == [("user", "hi!"), ("assistant", "good day"), ("user", "bye")]


def test_odd_events(spark):
    log = [
        (1, None, "message", "m0", None, None),
        (1, 1, "delta", "never opened", "user", "x"),
        (1, 1, "unknown", "m1", "user", "x"),
        (1, 1, "message", None, "user", "x"),
        (1, 2, "message", "m2", "user", "z"),
        (1, 2, "message", "m3", "user", "z"),
    ]
    assert chat.final_messages(spark.createDataFrame(log, EVENTS)).count() == 3
    assert chat.formatted(spark.createDataFrame([], EVENTS)).count() == 0


def test_round_trip_and_mask(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>x", "&amp; &lt; &lsq; &lf;", "", None, "漢字 🙂\n\n", "a" * 50_000]
    roles = ["user", "assistant", "sys\ntem<", None]
    rows = [(c, t, roles[(c + t) % 4], texts[(c * 3 + t) % 7]) for c in range(9) for t in range(c)]
    rows += [(3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, 0, "user", "x"), (4, None, "user", "first")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("event", F.lit(1))
    found = chat.formatted(chat.events_of(table.repartition(4)))
    got = {r["conv_id"]: r for r in chat.digests(found).collect()}
    shown = {r["conv_id"]: r for r in found.collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        turns = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in rows if c == conv)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(learned)
        text = shown[conv]["formatted"]
        assert got[conv]["formatted_chars"] == len(text)
        assert text.count("<") == 2 * len(turns) and "[INST]" not in text
        assert len(shown[conv]["loss_mask"]) == sum(r == "assistant" for _, r, _ in turns)
