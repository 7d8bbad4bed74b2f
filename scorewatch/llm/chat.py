"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context,
and only that reply lies under the loss mask. Turns after the last reply (or a
conversation without replies) give one closing example with an empty mask, so that
the output holds every turn.

Template: each turn is ``<s>[INST] role [/INST]text</s>``. Inside roles and texts a
backslash is doubled and every control string gets a backslash after its first
character, which `unescape` undoes exactly.

Defined cases: null role or text counts as empty; turns are ordered by (turn, role,
text) with null first, so equal turn numbers have one order; a null conv_id is a
conversation of its own; repeated rows are repeated turns; an empty table gives no rows.

Work is dealt by conversation and streamed in turn order: a task holds the formatted
text of one conversation, and never a group of conversations. The output is by
definition quadratic in the turns of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import table, written

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
EXAMPLES = "conv_id long, example int, turns int, text string, loss_start int, loss_end int, last boolean"
OUT_BYTES = 4 << 20


def escape(s: str) -> str:
    s = s.replace("\\", "\\\\")
    for c in CONTROL:
        s = s.replace(c, c[0] + "\\" + c[1:])
    return s


def unescape(s: str) -> str:
    for c in CONTROL:
        s = s.replace(c[0] + "\\" + c[1:], c)
    return s.replace("\\\\", "\\")


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn, and where its text begins."""
    head = f"<s>[INST] {escape(role)} [/INST]"
    return f"{head}{escape(text)}</s>", len(head)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    out = []
    for turn in formatted.split("</s>")[:-1]:
        role, _, text = turn.removeprefix("<s>[INST] ").partition(" [/INST]")
        out.append((unescape(role), unescape(text)))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("turns", pa.int32()), ("text", pa.string()),
                        ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("last", pa.bool_())])
    out, size = [], 0

    def examples():
        nothing = object()
        conv, held, context, fresh, n, k = nothing, None, "", [], 0, 0

        def ended() -> Iterator[tuple]:
            if fresh:  # turns after the last reply
                if held:
                    yield (*held, False)
                yield (conv, k, n, context + "".join(fresh), 0, 0, True)
            elif held:
                yield (*held, True)

        # An example is held back until it is known whether its conversation goes on.
        for cid, role, text in _rows(batches):
            if cid != conv:
                yield from ended()
                conv, held, context, fresh, n, k = cid, None, "", [], 0, 0
            turn, begin = format_turn(role or "", text or "")
            n += 1
            fresh.append(turn)
            if role == "assistant":
                if held:
                    yield (*held, False)
                context, fresh = context + "".join(fresh), []
                held = (conv, k, n, context, len(context) - len(turn) + begin, len(context) - len("</s>"))
                k += 1
        yield from ended()

    for row in examples():
        out.append(row)
        size += len(row[3])
        if size > OUT_BYTES:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)


def expand(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, example, turns, text, loss_start, loss_end, last): one per assistant
    turn (plus the closing example described above). The mask is in code points of `text`;
    `last` marks the example that holds every turn of its conversation."""
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (turns.select("conv_id", "turn", "role", "text").repartition(n, "conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
            .mapInArrow(_expand, EXAMPLES))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    state = None
    for b in batches:
        done = []
        for cid, whole, loss, chars in _rows([b]):
            if state is None:
                state = [hashlib.sha256(), 0, 0]
            loss = unescape(loss)
            state[0].update(loss.encode())
            state[1] += len(loss)
            state[2] += chars
            if whole is not None:  # the last example of the conversation
                turns = parse_turns(whole)
                h = hashlib.sha256()
                for role, text in turns:
                    h.update(f"{role}\n{text}\n".encode())
                done.append({"conv_id": cid, "n_turns": len(turns), "turns_sha256": h.hexdigest(), "loss_chars": state[1],
                             "loss_sha256": state[0].hexdigest(), "formatted_chars": state[2]})
                state = None
        yield pa.RecordBatch.from_pylist(done, schema)


def digests(examples: DataFrame) -> DataFrame:
    """Digest per conversation from written examples. Only each example's masked text, and
    the last example's whole text, are shuffled."""
    n = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    loss = F.expr("substring(text, loss_start + 1, loss_end - loss_start)")
    return (examples.select("conv_id", "example", F.when(F.col("last"), F.col("text")).alias("whole"), loss.alias("loss"),
                            F.length("text").cast("long").alias("chars"))
            .repartition(n, "conv_id").sortWithinPartitions("conv_id", "example").select("conv_id", "whole", "loss", "chars")
            .mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


def q_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text "
                      "FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return digests(written(expand(turns.unionByName(probe)), "chat-examples"))


QUERIES = {"op10_chat_prefix_targets": q_chat}
ORACLE: dict[str, str] = {}
