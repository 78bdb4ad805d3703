"""SentencePiece BPE encoding by backtracking, and decoding.

The pieces of a text are found left to right: take the longest piece at the position (from an Aho-Corasick automaton over the vocabulary);
if it does not agree with the piece before it, take the next shorter one; if none is left, mark the position as failed in a bitfield and go
back one piece. Two pieces agree if merging their joint characters anew, best score first, gives these two pieces again. A
sequence in which all neighbours agree is the one that merging the whole text gives: a merge across a boundary would also happen between the two alone.

Words are encoded one at a time with the blank in front (no piece has a blank after another character, checked when the model is
loaded), so codes of words are remembered, in two generations of ``REMEMBER`` words: the older goes when the younger is full, which changes speed only.

Decoding starts from the ids alone: the bytes of their pieces, laid one after the other, are read as UTF-8.

Null text counts as empty: no ids, empty decoded text. Repeated rows are coded one by one. A very long text is coded whole, in memory that grows with that text only.
An empty table gives an empty result; other columns stay, but for those named like the result.
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType

from tillroll.llm.common import arrow_rows

BLANK = "▁"
REMEMBER = 600_000
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class PieceModel:
    """A merge-type model with identity normalisation, a blank put in front and byte fallback."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.kinds, self.scores = [], [], []
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3) != 2 or not trainer.get(35):
                    raise ValueError("only merge-type models with byte fallback")
            elif number == 3:
                normal = dict(_fields(value))
                if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1):
                    raise ValueError("only models with identity normalisation, a blank in front and all blanks kept")
        if any(k in (USER, UNUSED) for k in self.kinds) or any(BLANK in p.lstrip(BLANK) for p, k in zip(self.pieces, self.kinds) if k == NORMAL):
            raise ValueError("pieces that this encoder does not cover")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.id_bytes = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.longest = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.line_breaks_alone = not any("\n" in p for p in self.ids)
        self.agreed: dict[tuple[int | str, int | str], bool] = {}
        self.names = list(map(str, range(len(self.pieces))))
        #: ids of words, joined by commas. A plain word stands for itself with a blank in front; see _key for the others.
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: Bytes of every id; control and unknown pieces have none.
        self.bytes = pa.array([self.id_bytes.get(i) or (p.encode() if k == NORMAL else b"") for i, (p, k) in enumerate(zip(self.pieces, self.kinds))], pa.large_binary())

    def merged(self, text: str) -> list[str]:
        """Merging from single characters: the neighbours whose joint piece has the best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[self.ids[j]], -i) for i in range(len(parts) - 1) if (j := parts[i] + parts[i + 1]) in self.ids), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _agree(self, left: int | str, right: int | str) -> bool:
        a, b = self._piece(left), self._piece(right)
        return self.merged(a + b) == [a, b]

    def _piece(self, i: int | str) -> str:
        return i if isinstance(i, str) else self.pieces[i]

    def fits(self, left: int | str, right: int | str) -> bool:
        """Whether two pieces (ids; a character without a piece stands for itself) agree."""
        known = self.agreed.get((left, right))
        if known is None:
            if len(self.agreed) > 1 << 20:
                self.agreed.clear()
            known = self.agreed[left, right] = self._agree(left, right)
        return known

    def whole(self, i: int | str) -> bool:
        p = self._piece(i)
        return len(p) == 1 or self.merged(p) == [p]

    def greedy(self, word: str) -> list[int] | None:
        """The longest pieces one after the other, if they fill the word and all agree: then there is nothing to go back for."""
        out, at, last, known = [], 0, -1, self.agreed
        for end, (i, size) in self.automaton.iter_long(word):
            if end - size + 1 != at or last >= 0 and not (known[last, i] if (last, i) in known else self.fits(last, i)):
                return None
            out.append(i)
            last, at = i, end + 1
        return out if at == len(word) and (len(out) > 1 or out and self.whole(last)) else None

    def split(self, text: str) -> list[int | str]:
        """The pieces of ``text`` by backtracking."""
        n = len(text)
        found: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):  # by growing end, so the sizes of a start grow too
            found[end - match[1] + 1].append(match)
        failed, out, ends, at, known = 0, [], [0], 0, self.agreed
        options = found[0] if n else []
        limit = n + 1
        while at < n:
            if not options or options[0][1] > 1:
                options = [(text[at], 1), *options]
            for i, size in reversed(options):
                if size >= limit or failed >> (at + size) & 1:
                    continue
                if (known[out[-1], i] if (out[-1], i) in known else self.fits(out[-1], i)) if out else self.whole(i):
                    out.append(i)
                    at += size
                    ends.append(at)
                    break
            else:  # the bitfield of positions that no sequence can pass
                failed |= 1 << at
                out.pop()
                limit = ends.pop()
                at = ends[-1]
                limit -= at
                options = found[at]
                continue
            options, limit = found[at] if at < n else [], n + 1
        return out

    def encode_word(self, word: str) -> list[int]:
        out = self.greedy(word)
        if out is None:
            out = []
            for i in self.split(word):
                if isinstance(i, str):
                    out.extend(self.byte_ids[b] for b in i.encode())
                else:
                    out.append(i)
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ``ids``: pieces joined, runs of byte pieces read as UTF-8, blanks as spaces, the one in front removed."""
        taken = self.bytes.take(pa.array(ids, pa.int32()))
        _, ends, data = taken.buffers()
        size = np.frombuffer(ends, np.int64)[len(taken)] if len(taken) else 0
        text = data.to_pybytes()[:size].decode("utf-8", "replace").replace(BLANK, " ") if size else ""
        return text[1:] if text.startswith(" ") else text

    def decode_joined(self, ids: str) -> str:
        """Text of ids that are joined by commas."""
        return self.decode(np.fromstring(ids, np.int32, sep=",")) if ids else ""

    cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall

    def learn(self, word: str, full: str) -> str:
        """Codes ``full``, remembered as ``word``; line breaks have no piece with other characters, so lines are coded by themselves."""
        ids = self.older.get(word)
        if ids is None:
            if "\n" in full[1:-1] and self.line_breaks_alone:
                ids = ",".join([self.words.get(k) or self.learn(k, x) for x in _lines.findall(full) for k in (_key(x),)])
            else:
                ids = ",".join([self.names[i] for i in self.encode_word(full)])
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def coded(self, text: str) -> str:
        """The ids of ``text`` joined by commas."""
        if not text:
            return ""
        if BLANK in text or "  " in text or text[0] == " " or text[-1] == " ":
            full = self.cut(BLANK + text.replace(" ", BLANK))
            words = list(map(_key, full))
        else:
            words, full = text.split(" "), None
        out = list(map(self.words.get, words))
        if None in out:
            for k, c in enumerate(out):
                if c is None:
                    out[k] = self.words.get(words[k]) or self.learn(words[k], full[k] if full else BLANK + words[k])
            if len(self.words) > REMEMBER:
                self.words, self.older = {}, self.words
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        ids = self.coded(text)
        return [int(i) for i in ids.split(",")] if ids else []


_lines = re.compile("\n|[^\n]+")


def _key(full: str) -> str:
    """What a word with its blanks is remembered as: without its blank if it has one, as it is if it has more (or is one), with a blank if it has none."""
    if full[0] != BLANK:
        return BLANK + full
    return full if full[1:2] in ("", BLANK) else full[1:]
_MODELS: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) for ``text``; a column of that name is replaced."""
    def one(texts: pa.Array) -> pa.Array:
        model = model_at(path)
        return _lists([model.coded(t or "") for t in texts.to_pylist()])
    return _with(docs, text, "ids", ArrayType(IntegerType()), one)


def decoded(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` (string) for ``ids``; a column of that name is replaced."""
    def one(lists: pa.Array) -> pa.Array:
        model = model_at(path)
        return pa.array([model.decode(x or []) for x in lists.to_pylist()], pa.string())
    return _with(docs, ids, "decoded", StringType(), one)


def _with(docs: DataFrame, column: str, name: str, kind: DataType, one) -> DataFrame:
    keep = [c for c in docs.columns if c != name]
    schema = docs.select(*keep).schema.add(name, kind)
    at = keep.index(column)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, one(b.column(at))], names=[*keep, name])

    return docs.select(*keep).mapInArrow(run, schema)


def _lists(joined: list[str]) -> pa.Array:
    """Lists of ids from their texts."""
    flat = ",".join([x for x in joined if x])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([x.count(",") + 1 if x else 0 for x in joined])]).astype(np.int32)), pa.array(np.fromstring(flat, np.int32, sep=",") if flat else np.empty(0, np.int32)))


def token_rows(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of ``keep``, n_tokens, ids and round_trip (whether decoding the ids gives the text) of every row."""
    schema = docs.select(*keep).schema.add("n_tokens", LongType()).add("ids", ArrayType(IntegerType())).add("round_trip", BooleanType())

    def run(batches):
        model = model_at(path)
        for b in batches:
            texts = [t or "" for t in b.column(len(keep)).to_pylist()]
            coded = [model.coded(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([c.count(",") + 1 if c else 0 for c in coded], pa.int64()), _lists(coded),
                                              pa.array([model.decode_joined(c) == t for c, t in zip(coded, texts)], pa.bool_())], names=[*keep, "n_tokens", "ids", "round_trip"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the codes of every text without building the lists of ids."""
    def one(batch: pa.RecordBatch) -> dict:
        model, n, a, b = model_at(path), [], [], []
        for t in batch.column("text").to_pylist():
            ids = model.coded(t or "")
            n.append(ids.count(",") + 1 if ids else 0)
            a.append(hashlib.sha256(ids.encode()).hexdigest())
            b.append(hashlib.sha256(model.decode_joined(ids).encode()).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
    return arrow_rows(docs.select("doc_id", "text"), one, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
