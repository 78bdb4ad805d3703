"""Chat formatting from event logs.

A log row is an event (conv_id, seq, kind, target, role, text): ``message`` opens message number ``target``, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate``
clears it for the deltas that follow, ``delete`` takes it away. A null kind is a message, a null target the event's own seq, null role and text are empty. Events
are dealt by conversation and message, so a long conversation is spread over tasks; each task sorts its events and folds them in one pass. Events of one
message that tie in seq are taken in the order message, edit, regenerate, delta, delete, then by role and text. A repeated ``message`` event opens one more
message after the first. An event before its message opens it.

A final message is rendered as one piece; a conversation is ``<s>`` and its pieces in order:
    user        [INST] text [/INST]
    assistant   text </s>            (with a blank in front; the text is under the loss mask)
    any other   <<SYS>>role, newline, text<</SYS>>
Control strings inside a text get a backslash after their first character and a backslash is doubled, so no text can end its turn and reading back restores it.
Reading back finds the ends of turns in the stream itself; what is no turn of this template is an error.

Very long texts stay whole; memory grows with one turn, not with a conversation. Empty tables give empty results. Extra columns of the log are not carried on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "<s>"
_control = re.compile(r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>")
_escaped = re.compile(r"\\(.)", re.S)
_rank = {"message": 0, "edit": 1, "regenerate": 2, "delta": 3, "delete": 4}


def escape(text: str) -> str:
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "\\" in text or "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """The piece of a turn and the span of its text that is under the loss mask (empty for all but the assistant)."""
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0
    if role == "assistant":
        return f" {body} </s>", 1, 1 + len(body)
    return f"<<SYS>>{escape(role).replace(chr(10), chr(92) + chr(10))}\n{body}<</SYS>>", 0, 0


_role = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)


class Reader:
    """Reads formatted conversations from parts of any size and finds the ends of turns itself."""

    def __init__(self) -> None:
        self.rest, self.begun = "", False

    def feed(self, part: str) -> list[tuple[str, str]]:
        """Roles and texts of the turns that end in ``part``; the beginning of a turn is kept for the next part."""
        text, at, out = self.rest + part, 0, []
        if not self.begun and len(text) >= len(START):
            if not text.startswith(START):
                raise ValueError("not a conversation of this template")
            self.begun, at = True, len(START)
        while self.begun and at < len(text):
            turn = self._turn(text, at)
            if turn is None:
                break
            out.append(turn[:2])
            at = turn[2]
        self.rest = text[at:]
        return out

    @staticmethod
    def _turn(text: str, at: int) -> tuple[str, str, int] | None:
        """Role, text and end of the turn at ``at``, None if it does not end in ``text``."""
        for mark, role, stop in _TURNS:
            if text.startswith(mark, at):
                begin = at + len(mark)
                if role is None:
                    head = _role.match(text, begin)
                    if head is None:
                        return None
                    role, begin = unescape(head[1]), head.end()
                end = text.find(stop, begin)
                return (role, unescape(text[begin:end]), end + len(stop)) if end >= 0 else None
            if mark.startswith(text[at:at + len(mark)]):
                return None
        raise ValueError("not a turn of this template")

    def close(self) -> None:
        """The end of the conversation; an error if a turn is still open."""
        if self.rest or not self.begun:
            raise ValueError("a turn or conversation that does not end")


#: Beginning, role (None: it follows, up to the end of the line) and end of the kinds of turns.
_TURNS = (("[INST] ", "user", " [/INST]"), (" ", "assistant", " </s>"), ("<<SYS>>", None, "<</SYS>>"))


def read_conversation(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a whole formatted conversation."""
    reader = Reader()
    out = reader.feed(text)
    reader.close()
    return out


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, copy (0, but for repeated messages), role, text of every final message."""
    kind = F.coalesce("kind", F.lit("message"))
    order = F.coalesce(*(F.when(kind == k, F.lit(r)) for k, r in _rank.items()), F.lit(9))
    e = events.select("conv_id", F.coalesce("target", "seq").cast("bigint").alias("message"), F.col("seq").cast("bigint").alias("seq"), order.alias("ord"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.where("ord < 9").repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "ord", "role", "text")
    names = ["conv_id", "message", "copy", "role", "text"]
    kind_of_id = events.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        open_: list[list] = []  # role, parts of the text
        done: list[tuple] = []

        def close() -> None:
            done.extend((*key, i, role, "".join(parts)) for i, (role, parts) in enumerate(m for m in open_ if m[1] is not None)) if key else None

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "ord", "role", "text"))):
                if row[:2] != key:
                    close()
                    key, open_ = row[:2], []
                _, _, o, role, text = row
                if o == 0 or not open_:
                    open_.append([role, [text] if o != 2 else []])
                elif open_[-1][1] is None:
                    continue
                elif o == 3:
                    open_[-1][1].append(text)
                else:
                    open_[-1][1] = [text] if o == 1 else []
                if o == 4:
                    open_[-1][1] = None
            if done:
                yield _batch(done, names, id_type)
                done = []
        if key is not None:
            close()
            if done:
                yield _batch(done, names, id_type)

    return e.mapInArrow(run, f"conv_id {kind_of_id}, message bigint, copy bigint, role string, text string")


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=names)


def formatted(messages: DataFrame) -> DataFrame:
    """``messages`` with piece, loss_start, loss_end instead of role and text."""
    kind_of_id = messages.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("message"), b.column("copy"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["conv_id", "message", "copy", "piece", "loss_start", "loss_end"])

    return messages.mapInArrow(run, f"conv_id {kind_of_id}, message bigint, copy bigint, piece string, loss_start bigint, loss_end bigint")


def digests(pieces: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, one row each: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The pieces stream past in order, so memory does not grow with a conversation; a hash over a conversation needs its pieces one after the other in one task.
    """
    kind_of_id = pieces.schema["conv_id"].dataType.simpleString()
    sorted_ = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "message", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, id_type, begun = None, None, False
        state: list = []
        reader = Reader()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c[0], id_type), pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3], pa.int64()), pa.array(c[4]), pa.array(c[5], pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close() -> tuple:
            reader.close()
            n, turns, chars, loss, size = state
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            id_type, rows = batch.schema.field("conv_id").type, []
            for conv, piece, a, z in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
                if not begun or conv != now:
                    if begun:
                        rows.append(close())
                    now, begun, state, reader = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), len(START)], Reader()
                    reader.feed(START)
                for role, text in reader.feed(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                masked = unescape(piece[a:z])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(piece)
            if rows:
                yield out(rows)
        if begun:
            yield out([close()])

    return sorted_.mapInArrow(run, f"conv_id {kind_of_id}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
