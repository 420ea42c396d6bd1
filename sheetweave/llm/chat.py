"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: a row whose text is all turns before it and the reply, and whose
loss mask, `loss_start` to `loss_end`, holds that reply alone. Examples grow with the square of a conversation, so
texts are spelled in full up to SPELLED code points; the text of a longer example goes on where the example (or piece)
before it ends, and `text_start` says how much of its context that is. A last row without a mask holds turns after the
last reply, and rows without a mask also hold what a long stretch without a reply says, so that no row is longer than
SPELLED and one turn, and a task keeps no more than that of a conversation.

Defined results: null text or role counts as empty; rows of one conversation are ordered by turn (null first), role
and text, so ties and repeated rows are turns of their own in a fixed order; null conv_id is a conversation; columns
beyond conv_id, turn, role and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, TARGET = "<|im_start|>", "<|im_end|>", "assistant"
RENDERED = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
#: Code points up to which an example is spelled in full.
SPELLED = 200_000
#: Offsets are code points in the conversation's formatted stream; `position` is that of the last turn in the row.
EXAMPLES = "conv_id long, position long, text_start long, text string, example_chars long, loss_start long, loss_end long"
ARROW = pa.schema([(c, pa.string() if c == "text" else pa.int64()) for c in ("conv_id", "position", "text_start", "text", "example_chars", "loss_start", "loss_end")])


def escape_text(col):
    """No control string is left in the text: `<`, any backslashes and `|` get one more backslash between."""
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def escape_role(col):
    """Roles also escape line feeds, since a line feed ends them."""
    return escape_text(F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_text(role))


def expand_examples(conversations: DataFrame, spelled: int = SPELLED) -> DataFrame:
    """The examples (columns EXAMPLES), by conversation and position within partitions; rows without `loss_end` are
    context that no reply follows in the same row."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = (
        conversations.select(F.col("conv_id").cast("long"), "turn", blank("role").alias("role"), blank("text").alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select(
            "conv_id",
            (F.col("role") == TARGET).alias("target"),
            F.concat(F.lit(START), escape_role("role"), F.lit("\n"), escape_text("text"), F.lit(END + "\n")).alias("rendered"),
            F.char_length(escape_text("text")).alias("reply"),
        )
    )

    def expand(batches):
        conv, position, total, whole, since = (), -1, 0, [], []
        out: list[tuple] = []

        def put(loss):
            """A row that ends with the turn at `position`."""
            if total <= spelled:
                text, since[:] = "".join(whole), []
            else:
                text = "".join(since)
                since.clear()
                whole.clear()
            out.append((conv[0], position, total - len(text), text, total, *loss))

        for batch in batches:
            for key, rendered, target, reply in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "target", "reply")), strict=True):
                if conv != (key,):
                    if since:
                        put((None, None))
                    conv, position, total, whole, since = (key,), -1, 0, [], []
                position, total = position + 1, total + len(rendered)
                since.append(rendered)
                if total <= spelled:
                    whole.append(rendered)
                if target:
                    stop = total - len(END) - 1
                    put((stop - reply, stop))
                elif total > spelled and sum(map(len, since)) > spelled:  # a stretch without a reply
                    put((None, None))
                if sum(len(r[3]) for r in out[-50:]) > 8_000_000 or len(out) >= 5_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in out], ARROW)
                    out.clear()
        if since:
            put((None, None))
        yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in out], ARROW)

    return turns.mapInArrow(expand, EXAMPLES)


def digest(examples: DataFrame) -> DataFrame:
    """What the examples say when read again, a row per conversation.

    turns_sha256 is over role, line feed, text, line feed of each turn, parsed from the texts; loss_chars and loss_sha256
    over the unescaped text under the loss masks, example by example; formatted_chars counts all examples, contexts
    included, and the stream again where turns follow the last reply.
    """

    def read(batches):
        columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "stream_chars")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        out, conv, state = [], None, None

        def close():
            n, turns_hash, chars, loss_hash, formatted, examples, stream, covered = state
            out.append((conv[0], n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted + (stream if covered < stream else 0), examples, stream))

        for batch in batches:
            for key, start, text, chars, loss_start, loss_end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text_start", "text", "example_chars", "loss_start", "loss_end")), strict=True):
                if conv != (key,):
                    if conv:
                        close()
                    conv, state = (key,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, 0]
                # turns that the row before has not shown yet
                at = state[6] - start
                while at < len(text):
                    turn = RENDERED.match(text, at)
                    state[0] += 1
                    state[1].update(f"{unescape_role(turn[1])}\n{unescape_text(turn[2])}\n".encode())
                    at = turn.end()
                state[6] = chars
                if loss_end is not None:
                    reply = unescape_text(text[loss_start - start : loss_end - start])
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                    state[4] += chars
                    state[5] += 1
                    state[7] = chars
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], columns)
                out.clear()
        if conv:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], columns)

    return examples.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, stream_chars long")
