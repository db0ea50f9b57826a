"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is
trainable. Consecutive examples of a conversation share their prefix, so an example is kept as what it adds to the
example before it (`added`) and the length of what it repeats (`shared_chars`); the stored size is linear in the
conversation, not quadratic. `expanded` makes the examples from it, each with its whole context; they stream out one by
one, and what is read back is read from them.

Template: `<|im_start|>role<|im_sep|>text<|im_end|>` and a line end for each turn. Inside roles and texts each
control string gets a backslash behind its first character and each backslash is doubled, so no text can hold a
control string and `unescape` gives the text back.

Nulls: a null role or text is empty, a null turn sorts first, rows with a null conv_id are one conversation. Ties in
turn are ordered by role, then text; repeated rows stay. Turns behind the last reply form records without a target (as
does every stretch of MOST_HELD characters without a reply), so nothing is lost. A task holds the text of one example. An
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of this and of other public chat templates; none may stand in an escaped text.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\"]
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)")

#: Characters of turns that wait for a reply before they are stored without one.
MOST_HELD = 1 << 20

EXAMPLES = "conv_id bigint, example int, shared_chars bigint, added string, loss_start bigint, loss_end bigint"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(\\?)", r"\1", text)


def in_order(conversations: DataFrame) -> DataFrame:
    """The turns, each conversation in one partition and in order; partitions are streamed, never gathered."""
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _same(a, b) -> bool:
    return a == b or (a is None and b is None)


def _ids(col: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in col]


def examples(conversations: DataFrame) -> DataFrame:
    """Columns EXAMPLES: one row for each assistant turn, and rows without a target for turns that no reply follows.

    An example's text is the `added` of all rows of its conversation up to its own, in order of `example`;
    loss_start and loss_end are code points within it and hold the reply alone."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, shared, size, number = object(), [], 0, 0, 0
        out: list[tuple] = []
        for pdf in batches:
            for conv, role, text in zip(_ids(pdf.conv_id), pdf.role, pdf.text, strict=True):
                if not _same(conv, now):
                    if held:
                        out.append((now, number, shared, "".join(held), None, None))
                    now, held, shared, size, number = conv, [], 0, 0, 0
                head, body = f"{START}{escape(role)}{SEP}", escape(text)
                held.append(f"{head}{body}{END}")
                begin = size + len(head)
                size += len(held[-1])
                if role == "assistant":
                    out.append((conv, number, shared, "".join(held), begin, begin + len(body)))
                    held, shared, number = [], size, number + 1
                elif size - shared > MOST_HELD:
                    out.append((conv, number, shared, "".join(held), None, None))
                    held, shared, number = [], size, number + 1
            yield _frame(out)
            out = []
        if held:
            yield _frame([(now, number, shared, "".join(held), None, None)])

    return in_order(conversations).select("conv_id", "role", "text").mapInPandas(expand, EXAMPLES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["conv_id", "example", "shared_chars", "added", "loss_start", "loss_end"])
    return pdf.astype({"conv_id": "Int64", "example": "int32", "shared_chars": "int64", "loss_start": "Int64", "loss_end": "Int64"})


FULL = "conv_id bigint, example int, text string, loss_start bigint, loss_end bigint"


def expanded(stored: DataFrame) -> DataFrame:
    """Columns FULL: each record with its whole text, all turns before it included, and the span of its reply (null without
    one), in order of example within a conversation, whose records lie in one partition.

    Its size is that of all prefixes together; batches of about MOST_HELD characters stream out."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
        now, prefix, out, chars = object(), "", [], 0
        for batch in batches:
            for conv, number, added, a, b in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                prefix = (prefix if _same(conv, now) else "") + added
                now, chars = conv, chars + len(prefix)
                out.append((conv, number, prefix, a, b))
                if chars > MOST_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    one = stored.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return one.select("conv_id", "example", "added", "loss_start", "loss_end").mapInArrow(spell, FULL)


def full_examples(stored: DataFrame) -> DataFrame:
    """The examples with their whole text, context included: columns FULL."""
    return expanded(stored).where(F.col("loss_start").isNotNull())


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted stretch of whole turns."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition(SEP)
        turns.append((unescape(role), unescape(text)))
    return turns


def read_back(stored: DataFrame) -> DataFrame:
    """Per conversation, from its expanded examples: conv_id, n_turns, turns_sha256 (of role, line end, text and line end of
    each turn), loss_chars, loss_sha256 (of the unescaped text under the loss mask), formatted_chars (of the last record,
    context included), n_examples."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row():
            whole, turns = hashlib.sha256(), parse(last)
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            return (now, len(turns), whole.hexdigest(), loss, masked.hexdigest(), len(last), count)

        now, last, loss, count, masked, out = None, None, 0, 0, hashlib.sha256(), []
        for pdf in batches:
            for conv, text, a, b in zip(_ids(pdf.conv_id), pdf.text, pdf.loss_start, pdf.loss_end, strict=True):
                if last is None or not _same(conv, now):
                    if last is not None:
                        out.append(row())
                    now, loss, count, masked = conv, 0, 0, hashlib.sha256()
                last = text
                if not pd.isna(a):
                    reply = unescape(text[int(a) : int(b)])
                    loss, count = loss + len(reply), count + 1
                    masked.update(reply.encode())
            yield _digests(out)
            out = []
        if last is not None:
            yield _digests([row()])

    # the records of a conversation stay in order in their partition: nothing is shuffled between the two
    return expanded(stored).select("conv_id", "text", "loss_start", "loss_end").mapInPandas(
        digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint")


def _digests(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"])
    return pdf.astype({"conv_id": "Int64"} | dict.fromkeys(["n_turns", "loss_chars", "formatted_chars", "n_examples"], "int64"))
