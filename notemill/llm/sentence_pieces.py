"""Encoding and decoding with a merge-type SentencePiece model, by a table of last tokens.

In a merge-type vocabulary the encoding of every prefix of a text has one last token, and two tokens
may stand side by side exactly when merging their joined characters gives these two again. So:

* an automaton over all pieces reports which of them end at a place of the text;
* the one among them that is compatible with the last token of the prefix before it is the last token
  of the prefix that ends here, and is stored;
* the ids are read from the table backwards.

No queue of merges is kept, and the work is linear in the text. Whether two tokens are compatible is
found by running their two merge histories side by side: they are, unless a merge across the border
comes first at some moment. Answers are kept by pair.

No piece of such a model holds a blank mark after another character (otherwise texts are not cut), so
a text falls into stretches that are encoded for themselves, once per distinct stretch of a slice.

Every text stays in its own row and task: no shuffle, and no key that could be hot. The model's file
is read on the driver and broadcast (its size is that of the vocabulary).

Defined cases: a null or empty text has no pieces (its list holds the end id alone, if one is asked
for). A very long text is worked off in one task, in memory proportional to it. Characters without a
piece become byte pieces, or the unknown id where the model has none. Rows are independent: ties,
repeated rows and repeated or null ids change nothing; an empty table gives an empty table. Columns
of the input that carry an output's name are replaced, all others are kept.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from notemill.llm import tables, words

SLICE_BYTES = 4 << 20
KEPT_LENGTH = 64  # stretches up to this many characters are remembered between slices
KEPT = 100_000  # as many of them at most, in each worker
KEPT_PAIRS = 1_000_000
DECODED_AT_ONCE = 1 << 16
# Fixed value: stands for a blank inside pieces.
MARK = "▁"
NEVER = float("-inf")


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("notemill.each_byte", _each_byte)


class Model:
    """Pieces, scores and bytes of a model, with the tables that encoding and decoding need."""

    def __init__(self, content: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=content)
        ids = range(library.get_piece_size())
        if any(map(library.is_unused, ids)):
            raise ValueError("models with unused pieces are not supported")
        self.library = library
        self.end = library.eos_id()
        self.unknown = library.unk_id()
        kind = {i: "byte" if library.is_byte(i) else "control" if library.is_control(i) else "piece" for i in ids}
        kind[self.unknown] = "unknown"
        pieces = {library.id_to_piece(i): i for i in ids if kind[i] == "piece"}
        self.id_of = pieces
        self.score = {p: library.get_score(i) for p, i in pieces.items()}
        self.byte_id = {int(library.id_to_piece(i)[3:5], 16): i for i in ids if kind[i] == "byte"}
        self.automaton = ahocorasick.Automaton()
        # Every symbol carries what is known about the tokens that may stand before it.
        self.before: dict[str, dict[str, bool]] = {symbol: {} for symbol in {*pieces, *"".join(pieces)}}
        for symbol, known in self.before.items():
            self.automaton.add_word(symbol, (symbol, len(symbol), known))
        self.automaton.make_automaton()
        inside = re.compile(f"[^{MARK}]{MARK}")
        self.cuts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not any(map(inside.search, pieces)) else None
        self.histories: dict[str, list[tuple[float, str, str]] | None] = {}
        self.n_pairs = 0
        self.stretches: dict[str, list[int]] = {}
        # Decoding: the bytes of every id, and which ids lose the blank before the first word.
        made = {
            "byte": lambda i: bytes([int(library.id_to_piece(i)[3:5], 16)]),
            "control": lambda i: b"",
            "unknown": lambda i: library.decode([i]).encode(),
            "piece": lambda i: library.id_to_piece(i).replace(MARK, " ").encode(),
        }
        self.bytes_of = [made[kind[i]](i) for i in ids]
        self.silent = {i for i in ids if kind[i] == "control"}
        prefixed = library.normalize("a").startswith(MARK)
        self.led = {i for i in ids if prefixed and kind[i] == "piece" and library.id_to_piece(i).startswith(MARK)}

    def history(self, token: str) -> list[tuple[float, str, str]] | None:
        """The merges that build ``token``: score, first and last symbol afterwards. None if they end elsewhere."""
        if token not in self.histories:
            symbols, merges = list(token), []
            while len(symbols) > 1:
                joined = [self.score.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
                best = max(joined)
                if best == NEVER:
                    break
                at = joined.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                merges.append((best, symbols[0], symbols[-1]))
            self.histories[token] = merges if len(symbols) == 1 else None
        return self.histories[token]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both tokens gives these two; an empty left stands for the text's start."""
        known = self.before.get(right, {})
        if left not in known:
            if self.n_pairs >= KEPT_PAIRS:
                self.n_pairs = 0
                for held in self.before.values():
                    held.clear()
            self.n_pairs += 1
            known[left] = self._stay_apart(left, right) if left else self.history(right) is not None
        return known[left]

    def _stay_apart(self, left: str, right: str) -> bool:
        before, after = self.history(left), self.history(right)
        if before is None or after is None:
            return False
        last, first = left[-1], right[0]
        i = j = 0
        while True:
            ours = before[i][0] if i < len(before) else NEVER
            theirs = after[j][0] if j < len(after) else NEVER
            across = self.score.get(last + first, NEVER)
            # The highest score is merged first, of equal ones the leftmost.
            if across > ours and across >= theirs and across > NEVER:
                return False
            if ours == theirs == NEVER:
                return True
            if ours >= theirs:
                last = before[i][2]
                i += 1
            else:
                first = after[j][1]
                j += 1

    def last_tokens(self, text: str) -> list[str]:
        """For every length of a prefix, the last token of its encoding; empty for a character that no piece holds."""
        last = [""] * (len(text) + 1)
        for end, (token, size, known) in self.automaton.iter(text):
            stop = end + 1
            if last[stop]:
                continue
            start = stop - size
            # A character that no piece holds is a token of its own.
            left = (last[start] or text[start - 1]) if start else ""
            fits = known.get(left)
            if fits is None:
                fits = self.compatible(left, token)
            if fits:
                last[stop] = token
        return last

    def encode_stretch(self, text: str) -> list[int]:
        known = self.stretches.get(text)
        if known is not None:
            return known
        last, id_of = self.last_tokens(text), self.id_of
        ids: list[int] = []
        at = len(text)
        while at:
            token = last[at] or text[at - 1]
            number = id_of.get(token)
            if number is not None:
                ids.append(number)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in reversed(token.encode())]
            else:
                ids.append(self.unknown)
            at -= len(token)
        ids.reverse()
        if len(text) <= KEPT_LENGTH:
            if len(self.stretches) >= KEPT:
                self.stretches.clear()
            self.stretches[text] = ids
        return ids

    def encode(self, texts: pa.Array, end: bool) -> pa.Array:
        """Lists of ids; every distinct stretch of the texts is encoded once."""
        numbers: dict[str, int] = {}
        found = []
        for text in texts:
            plain = self.library.normalize(text.as_py() or "")
            parts = [plain] * bool(plain) if self.cuts is None else self.cuts.findall(plain)
            found.append(np.array([numbers.setdefault(p, len(numbers)) for p in parts], dtype=np.int32))
        encoded = [self.encode_stretch(s) for s in numbers]
        if end:
            found = [np.append(f, len(encoded)) for f in found]
            encoded.append([self.end])
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(size.sum()))
        first = np.cumsum(size) - size
        out = [flat[words.ranges(first[f], size[f])] for f in found]
        return tables.lists(pa.array(np.concatenate([*out, np.zeros(0, np.int32)])), [len(o) for o in out])

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids, without the blank that encoding puts before the first word."""
        made = [b"".join([self.bytes_of[i] for i in ids[at : at + DECODED_AT_ONCE].tolist()]) for at in range(0, len(ids), DECODED_AT_ONCE)]
        text = b"".join(made).decode("utf-8", "notemill.each_byte")
        first = next((i for i in ids.tolist() if i not in self.silent), None) if len(ids) else None
        return text[1:] if first in self.led else text


_LOADED: dict[int, Model] = {}


def loaded(content: Broadcast) -> Model:
    """The worker's model for a broadcast file."""
    key = hash(content.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model(content.value)
    return _LOADED[key]


def broadcast_model(df: DataFrame, path: str) -> Broadcast:
    """Read the file on the driver, and refuse a model that does not merge."""
    with open(path, "rb") as file:
        content = file.read()
    model = Model(content)
    probe = " ".join(list(model.id_of)[: 1 << 10]).replace(MARK, " ")
    if model.encode(pa.array([probe]), False)[0].as_py() != model.library.encode(probe):
        raise ValueError("only merge-type models are supported")
    return df.sparkSession.sparkContext.broadcast(content)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """The columns of ``docs`` with ``ids``, the piece ids of ``text``, in place of the text.

    With ``end`` the model's end id follows the pieces.
    """
    model = broadcast_model(docs, model_path)
    rows = tables.carried(docs, text, (ids,))
    kept = [c for c in docs.columns if c not in (text, ids)]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "_text", SLICE_BYTES):
                made = loaded(model).encode(part.column("_text"), end)
                yield pa.RecordBatch.from_arrays([part.column("_row"), made], names=["_row", ids])

    schema = T.StructType([rows.schema["_row"], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(encoded, schema).select(*[f"_row.`{c}`" for c in kept], ids)


def decode(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``text``, the text of the piece ids; null ids give a null text."""
    model = broadcast_model(docs, model_path)
    rows = tables.carried(docs, ids, (text,))
    kept = [c for c in docs.columns if c not in (text, ids)]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_text")
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            made = [loaded(model).decode(flat[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], valid)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), column, pa.array(made, pa.string())], names=["_row", ids, text]
            )
            words.give_back()

    schema = T.StructType([rows.schema["_row"], T.StructField(ids, docs.schema[ids].dataType), T.StructField(text, T.StringType())])
    return rows.mapInArrow(decoded, schema).select(*[f"_row.`{c}`" for c in kept], ids, text)
