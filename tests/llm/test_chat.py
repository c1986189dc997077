import duckdb
import pytest

from termweave.llm import chat

TEXTS = ["", "plain", "<|s|>", "<|/s|><|s|>x", "a\\b <| \\p <\\p", "<|e|>", "\\", "\\n\n", "x" * 50000, "é😀<|/s|>"]


def rows(spark):
    data = [(i, j, ("assistant" if j % 2 else "user"), t) for i, t in enumerate(TEXTS) for j in range(3)]
    data += [(50, 0, None, None), (51, 1, "user\n<|", "tie"), (51, 1, "user\n<|", "tie"), (51, None, "assistant", "first"), (None, 0, "user", "<|s|>")]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_round_trip(spark):
    frame = rows(spark)
    got = {r.conv_id: r for r in chat.format_chats(frame.withColumn("formatted", chat.F.lit(1))).collect()}
    for i, t in enumerate(TEXTS):
        assert [x.text for x in got[i].turns] == [t] * 3
        assert got[i].escaped == any(c in t for c in (chat.OPEN, chat.CLOSE, chat.MARK))
    assert [(x.role, x.text) for x in got[50].turns] == [("", "")]
    assert [(x.role, x.text) for x in got[51].turns] == [("assistant", "first"), ("user\n<|", "tie"), ("user\n<|", "tie")]
    assert got[None].escaped


def test_mask_covers_assistant_texts(spark):
    """Spans of the formatted text, counted in code points by Python, hold each assistant text
    once; cut out again they are the source texts."""
    odd = ["é😀" * 3000 + "<|s|>", "x" * 1023, "x" * 1024 + "\n", "", "assistant\nno turn", "<|/s|>assistant\nno turn"]
    frame = rows(spark).unionByName(spark.createDataFrame([(100 + i, j, r, t) for i, t in enumerate(odd) for j, r in enumerate(("user", "assistant", "user", "assistant"))], "conv_id long, turn long, role string, text string"))
    for r in chat.format_chats(frame).withColumn("loss", chat.masked(chat.F.col("formatted"), chat.F.col("mask"))).collect():
        want = [t.text for t in r.turns if t.role == "assistant"]
        assert r.loss == want
        raw = [r.formatted[s.start : s.end] for s in r.mask]
        assert [t.replace("<\\p", "<|").replace("\\b", "\\") if r.escaped else t for t in raw] == want
        assert all(r.formatted[: s.start].endswith("<|s|>assistant\n") and r.formatted[s.end :].startswith("<|/s|>") for s in r.mask)


def test_empty(spark):
    assert chat.format_chats(rows(spark).limit(0)).count() == 0


def test_query_against_sql(spark, tmp_path):
    rows(spark).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op9_chat_format(spark, str(tmp_path)).collect()
    duckdb_rows = duckdb.sql(chat.OP9_SQL.replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(duckdb_rows, key=key)
