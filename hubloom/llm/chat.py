"""Chat formatting by prefix-target expansion (operator 12).

Every assistant turn is an example of its own: all turns before it are its context, and only
its reply is trained on. An example's text is a prefix of the formatted conversation, so the
formatted text is written once, in blocks of whole turns, and an example says how far it goes
and where its reply stands: a conversation of any length costs its own size, not its square.
`example_texts` spells the examples out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from hubloom.llm.tables import read_table, stored

# The template of a turn. Control strings are "###", which opens a turn, and "</turn>".
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
# A backslash goes before what would read as a control string, or as an escape.
IN_TEXT, IN_ROLE = r"(\\|#(?=##)|<(?=/turn>))", r"(\\|#(?=##)|<(?=/turn>)|:)"
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
ESCAPE = re.compile(r"\\(.)", re.DOTALL)
TARGET_ROLE = "assistant"
# Characters of formatted text in a block; a longer turn is a block of its own.
BLOCK_CHARS = 1 << 18

TURN_SPANS = "array<struct<start:int,stop:int,loss_start:int,loss_stop:int>>"


def escaped(column: Column, pattern: str) -> Column:
    return F.regexp_replace(F.coalesce(column, F.lit("")), pattern, r"\\$1")


def unescaped(text: str) -> str:
    return ESCAPE.sub(r"\1", text)


def format_conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                         text: str = "text", target_role: str = TARGET_ROLE) -> DataFrame:
    """The formatted conversations as written blocks of whole turns.

    Columns conv_id, part, block (their order within a conversation), before_turns and
    before_chars (what comes before the block), chars, text, spans (of each turn in code points
    of the block: start and stop of the turn, loss_start and loss_stop of what is trained on;
    null for turns of other roles).

    Turns are sorted over all tasks by conversation and turn, so one that holds most rows is
    spread over many. Null texts and roles are empty; a null turn comes first; turns with
    one number are ordered by role, then by a hash of the text. Rows without a conversation
    form one that has no id. Repeated rows are turns like all others. Texts of any length are
    kept whole. An empty table gives an empty result. Other columns are not looked at.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col(role), IN_ROLE), F.lit(BETWEEN))
    body = escaped(F.col(text), IN_TEXT)
    rows = turns.select(
        F.col(key).alias("conv_id"), F.col(order).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), F.monotonically_increasing_id().alias("row"),
        F.concat(head, body, F.lit(CLOSE)).alias("text"), F.length(head).alias("head"), F.length(body).alias("body"))
    place = ["conv_id", "turn", "role", "tie", "row"]
    dealt = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", "block", "chars", "text", "spans"]
    span_type = pa.list_(pa.struct([(f, pa.int32()) for f in ("start", "stop", "loss_start", "loss_stop")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conversation, block, chars, texts, spans = None, 0, 0, [], []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([conversation], id_type), pa.array([part], pa.int32()), pa.array([block], pa.int64()),
                pa.array([chars], pa.int64()), pa.array(["".join(texts)], pa.string()),
                pa.array([spans], span_type)], names=names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "head", "body")]
            for conv, who, piece, head_chars, body_chars in zip(*columns):
                if texts and (conv != conversation or chars + len(piece) > BLOCK_CHARS):
                    yield flushed()
                    block = block + 1 if conv == conversation else 0
                    chars, texts, spans = 0, [], []
                if conv != conversation:
                    conversation, block = conv, 0
                loss = (chars + head_chars, chars + head_chars + body_chars) if who == target_role else (None, None)
                spans.append(dict(zip(("start", "stop", "loss_start", "loss_stop"), (chars, chars + len(piece), *loss))))
                texts.append(piece)
                chars += len(piece)
        if texts:
            yield flushed()

    blocks = stored(dealt.select("conv_id", "role", "text", "head", "body").mapInArrow(
        run, f"conv_id {kind}, part int, block long, chars long, text string, spans {TURN_SPANS}"))
    return with_offsets(blocks)


def with_offsets(blocks: DataFrame) -> DataFrame:
    """Add before_turns and before_chars: sums within a task's part of a conversation, then over the parts."""
    of = Window.partitionBy("conv_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("conv_id", "part", "block", F.size("spans").cast("long").alias("turns"), "chars")
    nothing = F.lit(0).cast("long")
    parts = (sizes.groupBy("conv_id", "part").agg(F.sum("turns").alias("turns"), F.sum("chars").alias("chars"))
             .select(F.col("conv_id").alias("c"), F.col("part").alias("p"),
                     F.coalesce(F.sum("turns").over(earlier), nothing).alias("part_turns"),
                     F.coalesce(F.sum("chars").over(earlier), nothing).alias("part_chars")))
    within = (sizes.withColumn("in_turns", F.coalesce(F.sum("turns").over(of), nothing))
              .withColumn("in_chars", F.coalesce(F.sum("chars").over(of), nothing))
              .join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
              .select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("block").alias("b"),
                      (F.col("part_turns") + F.col("in_turns")).alias("before_turns"),
                      (F.col("part_chars") + F.col("in_chars")).alias("before_chars")))
    return (blocks.join(within, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
                        & (F.col("block") == F.col("b")))
            .select("conv_id", "part", "block", "before_turns", "before_chars", "chars", "text", "spans"))


def expand_targets(blocks: DataFrame) -> DataFrame:
    """One example for each turn of the target role, of `format_conversations`.

    Columns conv_id, target_turn (from 0), context_turns, context_chars, chars (the example is
    the conversation's first so many code points), loss_start, loss_stop (trained on, code
    points of the example), reply (formatted, escapes and all), and part, block of the reply.
    A conversation without such turns has no example; what follows its last reply is in none.
    An empty reply is an example that trains on nothing.
    """
    spans = blocks.select("conv_id", "part", "block", "before_turns", "before_chars", "text", F.posexplode("spans"))
    at = lambda name: F.col("before_chars") + F.col(f"col.{name}")
    return (spans.filter("col.loss_start IS NOT NULL").select(
        "conv_id", (F.col("before_turns") + F.col("pos")).alias("target_turn"),
        (F.col("before_turns") + F.col("pos")).alias("context_turns"), at("start").alias("context_chars"),
        at("stop").alias("chars"), at("loss_start").alias("loss_start"), at("loss_stop").alias("loss_stop"),
        F.expr("substring(text, col.loss_start + 1, col.loss_stop - col.loss_start)").alias("reply"), "part", "block"))


def example_texts(blocks: DataFrame, examples: DataFrame) -> DataFrame:
    """The examples' whole texts in pieces: conv_id, target_turn, piece (from 0), text.

    A piece is a block, or its beginning in the last piece of an example; pieces joined in
    order are the example. Long conversations grow with their square here, as any table of
    their examples does; a piece stays a block's size.
    """
    wanted = examples.select(F.col("conv_id").alias("c"), "target_turn", F.col("chars").alias("wanted"))
    joined = blocks.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("before_chars") < F.col("wanted")))
    order = Window.partitionBy("conv_id", "target_turn").orderBy("before_chars")
    return joined.select(
        "conv_id", "target_turn", (F.row_number().over(order) - 1).cast("int").alias("piece"),
        F.expr("substring(text, 1, int(least(chars, wanted - before_chars)))").alias("text"))


def read_back(blocks: DataFrame, examples: DataFrame) -> DataFrame:
    """Digests of what the formatted blocks and the examples' masks say, one row a conversation.

    Columns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_examples, example_chars (of all examples). Turns are parsed from the text and unescaped;
    trained text is cut out by the examples' own offsets. Blocks arrive in order and go one by
    one, so a task holds one block whatever the length of a conversation.
    """
    masks = (examples.groupBy("conv_id", "part", "block").agg(
        F.array_sort(F.collect_list(F.struct("loss_start", "loss_stop", "chars"))).alias("masks"))
        .select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("block").alias("b"), "masks"))
    rows = (blocks.join(masks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
                        & (F.col("block") == F.col("b")), "left")
            .select("conv_id", "before_chars", "text", "masks"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "before_chars")
    kind = blocks.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conversation, id_type = False, None, None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            out: list[tuple] = []
            for conv, before, text, masks in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "before_chars", "text", "masks")]):
                if not begun or conv != conversation:
                    if begun:
                        out.append((conversation, turns, whole.hexdigest(), trained, loss.hexdigest(), chars, n, total))
                    begun, conversation = True, conv
                    turns = trained = chars = n = total = 0
                    whole, loss = sha256(), sha256()
                at = 0
                while at < len(text):
                    turn = TURN.match(text, at)
                    if turn is None:
                        raise ValueError(f"conversation {conv}: no turn at {before + at}")
                    whole.update(f"{unescaped(turn[1])}\n{unescaped(turn[2])}\n".encode())
                    turns, at = turns + 1, turn.end()
                for mask in masks or []:
                    reply = unescaped(text[mask["loss_start"] - before:mask["loss_stop"] - before])
                    loss.update(reply.encode())
                    trained, n, total = trained + len(reply), n + 1, total + mask["chars"]
                chars += len(text)
            if out:
                yield table(out, id_type)
        if begun:
            yield table([(conversation, turns, whole.hexdigest(), trained, loss.hexdigest(), chars, n, total)], id_type)

    def table(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                 "formatted_chars long, n_examples long, example_chars long")


# The conversation that the query adds.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def op12_prefix_targets(spark, sf_dir):
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(ADDED_ID).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"),
                                  F.lit(ADDED_TEXT))
    blocks = format_conversations(given.union(added))
    return read_back(blocks, expand_targets(blocks))


def _escapes(column: str) -> str:
    """Backslashes that escaping puts into a text, in DuckDB: runs of # hold overlapping control strings."""
    runs = f"regexp_extract_all({column}, '#{{3,}}')"
    return (f"len({column}) - len(replace({column}, '\\', '')) + len(array_to_string({runs}, '')) - 2 * len({runs})"
            f" + (len({column}) - len(replace({column}, '</turn>', ''))) // 7")


OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {ADDED_ID}, 0, 'user', '{ADDED_TEXT}' UNION ALL SELECT {ADDED_ID}, 1, 'assistant', '{ADDED_TEXT}'),
sized AS (
  SELECT *, {len(OPEN + BETWEEN + CLOSE)} + len(role) + {_escapes('role')} + len(role) - len(replace(role, ':', ''))
            + len(text) + {_escapes('text')} AS chars FROM turns),
running AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = '{TARGET_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{TARGET_ROLE}'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (role = '{TARGET_ROLE}') AS n_examples,
       coalesce(sum(upto) FILTER (role = '{TARGET_ROLE}'), 0)::BIGINT AS example_chars
FROM running GROUP BY conv_id
"""
