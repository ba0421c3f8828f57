"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all turns before it are context,
and only that reply is trainable. format_chat() gives the ordered pieces of
each transcript, where an example is the prefix of `context_chars` characters
followed by its own piece; examples() writes each of them out, prefix and
target, which grows with the square of a conversation's turns, and
examples_read() reads them back.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

OPEN, SAYS, CLOSE = "<|turn|>", "<|says|>", "<|done|>"
#: Control strings of this template and of common others.
CONTROL = [OPEN, SAYS, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")

PIECES = "conv_id long, piece long, role string, example long, context_chars long, context_crc32 long, formatted string, loss_start long, loss_chars long"


def escape(text: str) -> str:
    """Puts one backslash more behind the first character of each control
    string, escaped already or not; unescape() takes it off again."""
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def parse(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    role, _, rest = formatted[len(OPEN) :].partition(SAYS)
    return unescape(role), unescape(rest[: -len(CLOSE)])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, piece, example, offset, crc, begun = None, 0, 0, 0, 0, False
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in PIECES.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in kinds]
        for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if not begun or c != conv:
                conv, piece, example, offset, crc, begun = c, 0, 0, 0, 0, True
            head = OPEN + escape(role or "") + SAYS
            body = escape(text or "") + CLOSE
            target = role == "assistant"
            row = (c, piece, role or "", example if target else None, offset, crc, head + body, len(head) if target else None, len(body) - len(CLOSE) if target else 0)
            for column, value in zip(out, row):
                column.append(value)
            piece, example, offset, crc = piece + 1, example + target, offset + len(head) + len(body), _crc(head + body, crc)
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])


def _crc(text: str, before: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), before)


def format_chat(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to the pieces of every transcript.

    One row per turn, a conversation's rows together and in order of turn
    (null first; ties by role, then text): conv_id, piece (0, 1, ...), role,
    example (number of the reply; null for context only), context_chars
    and context_crc32 (length and checksum of the transcript before this
    piece), formatted (the turn),
    loss_start and loss_chars (the trainable span inside it, for replies).
    A null text or role is empty; null conv_ids form one conversation;
    repeated rows stay; further columns are ignored; no rows give no rows.

    Rows stream through one sorted pass, so a conversation of any length
    takes the memory of one batch.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow_map(ordered, _format, PIECES)


def expanded(pieces: DataFrame) -> DataFrame:
    """Examples with their whole context written out: (conv_id, example,
    input, loss_start, loss_end). For chosen conversations, as a data loader
    would take them; the total is quadratic in the turns of a conversation.
    One row a reply, also of the conversation of null ids; pieces in any
    order; conversations without a reply have no row; no rows give no rows."""
    target = pieces.where("example is not null").alias("t")
    joined = target.join(pieces.alias("c"), F.expr("t.conv_id <=> c.conv_id and c.piece <= t.piece"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("c.piece", "c.formatted"))), lambda x: x["formatted"])
    start = F.first(F.expr("t.context_chars + t.loss_start"))
    return joined.groupBy("t.conv_id", "t.example").agg(F.concat_ws("", parts).alias("input"), start.alias("loss_start"), (start + F.first("t.loss_chars")).alias("loss_end"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, begun, turns, loss, n, loss_n, chars, crc, examples = None, False, None, None, 0, 0, 0, 0, 0
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def row() -> tuple:
        return conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, examples

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        out: list[tuple] = []
        for c, piece, example, before, context, formatted, start, length in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "piece", "example", "context_chars", "context_crc32", "formatted", "loss_start", "loss_chars"))):
            if not begun or c != conv:
                if begun:
                    out.append(row())
                conv, begun, turns, loss, n, loss_n, chars, crc, examples = c, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0
            if piece != n:
                raise ValueError(f"piece {n} of conversation {c} is missing or stands twice")
            role, text = parse(formatted)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if example is not None:
                if (example, before, context) != (examples, chars, crc):
                    raise ValueError(f"the context of example {example} of conversation {c} isn't all that stands before it")
                reply = unescape(formatted[start : start + length])
                loss.update(reply.encode("utf-8", "surrogatepass"))
                loss_n, examples = loss_n + len(reply), examples + 1
            n, chars, crc = n + 1, chars + len(formatted), _crc(formatted, crc)
        yield batch_of(out)
    if begun:
        yield batch_of([row()])


def digests(pieces: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per conversation, read back from its pieces and examples.

    Every example is read: its context, by length and checksum, must be all
    of the transcript before its reply, and its reply is what its loss span
    unescapes to. A piece that is missing or stands twice, or a wrong
    context, is an error. Pieces may come in any order; `ordered` says that
    they come as format_chat gives them. A null conv_id is a conversation; no
    rows give no rows; further columns are ignored.
    """
    if not ordered:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return arrow_map(pieces, _digest, DIGEST)


EXAMPLES = "conv_id long, example long, turns long, input string, loss_start long, loss_end long"
WRITTEN = 16 << 20  # characters of examples in a batch


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(columns)], names=[n for n, _ in columns])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, begun, parts, tail, size, turns = None, False, [], False, 0, 0
    out: list[tuple] = []
    held = 0

    def rest() -> list[tuple]:
        return [(conv, None, turns, "".join(parts), None, None)] if begun and tail else []

    for batch in batches:
        for c, piece, example, formatted, start, length in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "piece", "example", "formatted", "loss_start", "loss_chars"))):
            if not begun or c != conv:
                out += rest()
                held += size * tail
                conv, begun, parts, tail, size, turns = c, True, [], False, 0, 0
            if piece != turns:
                raise ValueError(f"piece {turns} of conversation {c} is missing or stands twice")
            parts.append(formatted)
            turns, tail = turns + 1, example is None
            if example is not None:
                parts = ["".join(parts)]  # the prefix, and the target behind it
                out.append((c, example, turns, parts[0], size + start, size + start + length))
                held += len(parts[0])
            size += len(formatted)
            if held > WRITTEN:
                yield _batch(out, EXAMPLES)
                out, held = [], 0
        yield _batch(out, EXAMPLES)
        out, held = [], 0
    if begun and tail:
        yield _batch(rest(), EXAMPLES)


def examples(pieces: DataFrame, ordered: bool = False) -> DataFrame:
    """Every example written out, in one pass over sorted pieces: (conv_id,
    example, turns, input, loss_start, loss_end). input is the prefix of all
    turns before the reply, then the reply; turns counts them. Turns behind
    the last reply are no example's: they come with all before them in a last
    row without example and loss. A task holds one transcript at a time and
    about WRITTEN characters of examples; what it writes is quadratic in the
    turns of a conversation. `ordered` and null conv_ids as in digests()."""
    if not ordered:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return arrow_map(pieces, _expand, EXAMPLES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, begun, turns, loss, n, loss_n, count, before = None, False, None, None, 0, 0, 0, ""

    def row() -> tuple:
        return conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), len(before), count

    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            c, example, told, text, start, end = (batch.column(k)[i].as_py() for k in range(6))
            if not begun or c != conv:
                if begun:
                    out.append(row())
                conv, begun, turns, loss, n, loss_n, count, before = c, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            if not text.startswith(before) or not text.endswith(CLOSE):
                raise ValueError(f"an example of conversation {c} doesn't begin with all that stands before it")
            for turn in text[len(before) : -len(CLOSE)].split(CLOSE):  # texts hold no control string
                role, said = parse(turn + CLOSE)
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                n += 1
            if n != told or example is not None and (example != count or start < len(before) or end != len(text) - len(CLOSE)):
                raise ValueError(f"example {count} of conversation {c} is missing, stands twice, or has another mask")
            if example is not None:
                reply = unescape(text[start:end])
                loss.update(reply.encode("utf-8", "surrogatepass"))
                loss_n, count = loss_n + len(reply), count + 1
            before = text
        yield _batch(out, DIGEST)
    if begun:
        yield _batch([row()], DIGEST)


def examples_read(written: DataFrame, ordered: bool = False) -> DataFrame:
    """digests() of examples(): one row per conversation, all of it read from
    the examples. Each must begin with the whole one before it, and its mask
    must be its last turn's text; formatted_chars is the length of the last.
    Examples in any order, unless `ordered` says that they come as from
    examples()."""
    if not ordered:
        written = written.repartition("conv_id").sortWithinPartitions("conv_id", "turns")
    return arrow_map(written, _read, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra)
    return examples_read(examples(format_chat(rows), ordered=True), ordered=True)


_SQL = "([<\\[])(\\\\*)(" + _TAILS.replace("'", "''") + ")"
ORACLE = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(n, r)),
safe AS (SELECT *, length(regexp_replace(text, '{_SQL}', '\1\\\2\3', 'g')) + length(regexp_replace(role, '{_SQL}', '\1\\\2\3', 'g')) + {len(OPEN) + len(SAYS) + len(CLOSE)} AS size FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples FROM safe GROUP BY conv_id
"""
