"""Prefix-target expansion: exact round trip, and examples against a plain loop."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.compare import differences
from hubloom.llm import chat

TRICKY = ["", "\\", "\\\\### ", "####", "######", "</turn>", "<</turn>\n", "a: b\n### user: x</turn>\n", "\\</turn>", "#", "<", "é🙂\n",
          "### assistant: ok</turn>\n" * 3, "\\### Assistant: </turn> ok", "$1 \\$1"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def conversations(seed, count):
    draw = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(draw.choice([1, 2, 5, 9]) if conv else 400):
            role = draw.choice(["user", "assistant", "system", "tool: x", "a\\b###</turn>"])
            rows.append((conv, turn, role, "".join(draw.choice(TRICKY + ["word "] * 4) for _ in range(draw.randint(0, 6)))))
    draw.shuffle(rows)
    return rows


def formatted(turns):
    """The template by plain replacement, character by character."""
    def escape(text, more=""):
        out = []
        for k, c in enumerate(text):
            control = c == "\\" or c in more or text.startswith("###", k) or text.startswith("</turn>", k)
            out.append("\\" + c if control else c)
        return "".join(out)
    return [(f"### {escape(role, ':')}: ", escape(text), "</turn>\n") for role, text in turns]


@pytest.mark.parametrize("block", [60, 1 << 18])
def test_read_back_and_examples(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_CHARS", block)
    rows = conversations(1, 30)
    blocks = chat.format_conversations(frame(spark, rows)).cache()
    examples = chat.expand_targets(blocks).cache()
    by_conv = {}
    for conv, _, role, text in sorted(rows, key=lambda r: r[:2]):
        by_conv.setdefault(conv, []).append((role, text))
    read = {r["conv_id"]: r for r in chat.read_back(blocks, examples).collect()}
    assert read.keys() == by_conv.keys()
    spelled = {}
    short = examples.filter("conv_id > 0")
    for r in chat.example_texts(blocks, short).orderBy("conv_id", "target_turn", "piece").collect():
        spelled[r["conv_id"], r["target_turn"]] = spelled.get((r["conv_id"], r["target_turn"]), "") + r["text"]
    listed = {(r["conv_id"], r["target_turn"]): r for r in examples.collect()}
    wanted = 0
    for conv, turns in by_conv.items():
        parts = formatted(turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        total = 0
        for k, (role, text) in enumerate(turns):
            if role != "assistant":
                continue
            wanted += 1
            whole = "".join("".join(p) for p in parts[:k + 1])
            e = listed[conv, k]
            assert (e["context_turns"], e["chars"], e["reply"]) == (k, len(whole), parts[k][1])
            assert whole[e["loss_start"]:e["loss_stop"]] == parts[k][1] and chat.unescaped(e["reply"]) == text
            assert e["context_chars"] == len("".join("".join(p) for p in parts[:k]))
            if conv:
                assert spelled[conv, k] == whole
            total += len(whole)
        r = read[conv]
        assert r["turns_sha256"] == digest("".join(f"{a}\n{t}\n" for a, t in turns)) and r["n_turns"] == len(turns)
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), digest(loss))
        assert r["formatted_chars"] == sum(len("".join(p)) for p in parts) and r["example_chars"] == total
    assert len(listed) == wanted


def test_query_equals_its_sql(spark, tmp_path):
    rows = [r for r in conversations(2, 40) if r[0]]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert differences(chat.op12_prefix_targets(spark, str(tmp_path)), con, chat.OP12_SQL) == []


def test_edges(spark):
    long = "long text " * 60000
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (1, None, "user", "first"), (1, 1, "assistant", "x"),
            (1, 1, "assistant", "x"), (1, 2, None, None), (2, 1, "assistant", None), (3, 1, "user", long), (3, 2, "assistant", long),
            (4, 1, "user", "only a question")]
    clashing = frame(spark, rows).withColumns({c: F.lit("x") for c in ("row", "tie", "head", "body", "part", "block", "spans", "chars")})
    blocks = chat.format_conversations(clashing)
    examples = chat.expand_targets(blocks)
    read = {r["conv_id"]: r for r in chat.read_back(blocks, examples).collect()}
    assert {k: (r["n_turns"], r["n_examples"], r["loss_chars"]) for k, r in read.items()} == {
        None: (2, 1, 1), 1: (4, 2, 2), 2: (1, 1, 0), 3: (2, 1, len(long)), 4: (1, 0, 0)}
    assert read[1]["turns_sha256"] == digest("user\nfirst\nassistant\nx\nassistant\nx\n\n\n")
    assert read[3]["loss_sha256"] == digest(long) and read[4]["loss_sha256"] == digest("")
    none = chat.format_conversations(frame(spark, []))
    assert none.count() == chat.expand_targets(none).count() == chat.read_back(none, chat.expand_targets(none)).count() == 0


def test_one_conversation_spreads_over_tasks(spark):
    rows = spark.range(20000).selectExpr("5L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role",
                                         "concat('text ', id) AS text").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = chat.format_conversations(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert blocks.select("part").distinct().count() > 4
    read = chat.read_back(blocks, chat.expand_targets(blocks)).collect()
    loss = "".join(f"text {k}" for k in range(1, 20000, 2))
    assert [(r["n_turns"], r["n_examples"], r["loss_sha256"]) for r in read] == [(20000, 10000, digest(loss))]
