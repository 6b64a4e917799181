"""Chat formatting from event logs.

An event has conv_id, seq, kind, turn, role, text. Kinds: message opens a message of its turn with a first text; delta
adds text to the turn; edit and regenerate set the turn's text anew and discard all later turns that were there (what
follows regenerate are deltas or nothing). Events are taken by conversation in order of seq (ties: turn, kind, role,
text), folded into final messages, and rendered as

    <|im_start|>role\\ntext<|im_end|>\\n

Every run of backslashes between < and | inside a text or role gets one more, so no control string stands inside a
text, and removing one gives the text back; in roles, backslash and line feed are escaped first.

Nulls: a null text or role is empty, a null kind is message, null conversations are one conversation, null turns come
first. Events that are equal in everything each count. An empty table gives nothing. Extra columns are ignored. A long
conversation is folded and rendered by many tasks, each of which has stretches of 1,024 turns: what an edit of an earlier
stretch discards is told by the last one's seq, a number for each stretch. Parts have a bounded size and are written as a
stream, so no task needs more memory than the longest message, whose events stay together.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns with like leading bits, 2 ** BITS of them, are a stretch: a conversation is handled stretch by stretch.
BITS = 10
START, END = "<|im_start|>", "<|im_end|>"
ESCAPE = re.compile(r"<(\\*)\|")
UNESCAPE = re.compile(r"<(\\*)\\\|")
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
PART = 1 << 20
RESETS = "kind in ('edit', 'regenerate')"
ORDER = ["conv_id", "turn", "seq", "kind", "role", "text"]


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def in_lots(rows: DataFrame) -> DataFrame:
    """rows with their conversation and stretch as one value, lot: as parts of a struct nulls equal each other."""
    return rows.withColumn("lot", F.struct("conv_id", F.shiftright("turn", BITS).alias("stretch")))


def earlier(lots: DataFrame, what: Column) -> DataFrame:
    """lot, older: what holds for all earlier stretches of its conversation. lots: a row for each stretch."""
    before = Window.partitionBy("lot.conv_id").orderBy(F.asc_nulls_first("lot.stretch")).rowsBetween(Window.unboundedPreceding, -1)
    return lots.select("lot", what.over(before).alias("older"))


def surviving(events: DataFrame) -> DataFrame:
    """The events that still count, with their lot: those after the last edit or regenerate of their turn, or that one
    itself, whose turn no later edit or regenerate of an earlier turn discarded."""
    rows, reset = in_lots(events), F.max(F.when(F.expr(RESETS), F.col("seq")))
    inside = Window.partitionBy("lot").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.join(earlier(rows.groupBy("lot").agg(reset.alias("seq")), F.max("seq")), "lot")
    rows = rows.withColumn("until", F.greatest("older", F.when(F.col("turn").isNotNull(), reset.over(inside))))
    left = rows.where("until is null or seq >= until").drop("older", "until")
    own = Window.partitionBy("lot", "turn").orderBy(F.desc("seq"), F.desc("kind"), F.desc("role"), F.desc("text"))
    first = Window.partitionBy("lot", "turn").orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    role = F.when((F.col("kind") == "message") | (F.col("role") != ""), F.col("role")).otherwise(F.coalesce(F.last(F.nullif("role", F.lit("")), ignorenulls=True).over(first), F.lit("")))
    left = left.withColumn("role", role).withColumn("_reset", F.max(F.expr(RESETS).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    return left.where(F.coalesce(F.col("_reset"), F.lit(0)) == 0).drop("_reset")


def normal(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


RENDERED = "conv_id long, stretch long, part long, n_messages long, formatted string, loss array<struct<start: long, stop: long>>"
RENDERED_TYPE = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("part", pa.int64()), ("n_messages", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def render(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """events: as from surviving(). Parts of the rendered conversations: a conversation is its parts in order of stretch (null first) and part, which
    counts from 0 in each stretch. loss: spans of code points of the part in which the loss counts, the texts of loss_role."""

    def run(batches):
        key, part, n, out, spans, size = None, 0, 0, [], [], 0
        message = None  # conv_id, turn, role, texts

        def close():
            nonlocal size, n
            if message:
                head, body = f"{START}{escape_role(message[2])}\n", escape("".join(message[3]))
                if message[2] == loss_role:
                    spans.append({"start": size + len(head), "stop": size + len(head) + len(body)})
                out.append(f"{head}{body}{END}\n")
                size += len(out[-1])
                n += 1

        def emit():
            nonlocal part, n, size
            row = {"conv_id": key[0], "stretch": key[1], "part": part, "n_messages": n, "formatted": "".join(out), "loss": list(spans)}
            part, n, size = part + 1, 0, 0
            out.clear()
            spans.clear()
            return row

        for b in batches:
            rows = []
            for conv, at, turn, kind, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "stretch", "turn", "kind", "role", "text"))):
                if message and message[0] == conv and message[1] == turn and kind != "message":
                    message[3].append(text)
                    message[2] = message[2] or role
                    continue
                close()
                if message and (key != (conv, at) or size >= PART):
                    rows.append(emit())
                    part = part if key == (conv, at) else 0
                key, message = (conv, at), [conv, turn, role, [text]]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=RENDERED_TYPE)
        close()
        if message:
            yield pa.RecordBatch.from_pylist([emit()], schema=RENDERED_TYPE)

    dealt = events.repartition("lot").sortWithinPartitions(*ORDER).withColumn("stretch", F.col("lot.stretch")).drop("lot")  # no new exchange: surviving() deals by lot
    return dealt.mapInArrow(run, RENDERED)


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered part: role and text."""
    return [(unescape_role(r), unescape(t)) for r, t in TURN.findall(formatted)]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(rendered: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the parts. Its hashes are each one sequence: parts stream through
    the task of their conversation, one at a time."""
    names = [x.split(" ")[0] for x in DIGEST.split(", ")]

    def run(batches):
        now = None  # conv_id, n_turns, sha of turns, loss_chars, sha of loss, formatted_chars

        def done():
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        def batch(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            rows = []
            for conv, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if not now or now[0] != conv:
                    if now:
                        rows.append(done())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    said = unescape(text[s["start"] : s["stop"]])
                    now[3] += len(said)
                    now[4].update(said.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            if rows:
                yield batch(rows)
        if now:
            yield batch([done()])

    return rendered.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "part").mapInArrow(run, DIGEST)


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Event log to rendered parts (see RENDERED)."""
    return render(surviving(normal(events)), loss_role)


def from_turns(conversations: DataFrame) -> DataFrame:
    """A table with one row for each turn as the log of chats that were streamed and revised: texts come in two parts;
    an answer is first drafted, then regenerated, and what a user says is first drafted and answered, then edited, which
    discards that answer. Rows of a conversation are numbered by turn (null first), role and text, stretch by stretch;
    that number is the turn of the log."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = in_lots(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")))
    older = earlier(rows.groupBy("lot").agg(F.count(F.lit(1)).alias("n")), F.sum("n"))
    order = Window.partitionBy("lot").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("here", F.row_number().over(order)).join(older, "lot")
    rows = rows.select("conv_id", (F.coalesce("older", F.lit(0).cast("long")) + F.col("here")).alias("turn"), "role", "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    parts = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text"))

    def event(k: int, kind: str, said: Column, ahead: int = 0) -> Column:
        who = F.lit("assistant") if ahead else F.col("role")
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), (F.col("turn") + ahead).alias("turn"), who.alias("role"), said.alias("text"))

    draft = event(0, "message", F.lit("draft ")), event(1, "delta", parts[1])
    answer = F.array(*draft, event(3, "regenerate", parts[0]), event(4, "delta", parts[1]))
    question = F.array(*draft, event(2, "message", F.lit("answer to a draft"), ahead=1), event(3, "edit", parts[0]), event(4, "delta", parts[1]))
    plain = F.array(event(0, "message", parts[0]), event(1, "delta", parts[1]))
    log = F.when(F.col("role") == "assistant", answer).when(F.col("role") == "user", question).otherwise(plain)
    events = rows.select("conv_id", (F.col("turn") * 5).alias("first"), F.inline(log))
    return events.select("conv_id", (F.col("first") + F.col("k")).alias("seq"), "kind", "turn", "role", "text")
