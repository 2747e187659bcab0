"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

BPE merges the adjacent pair whose joined piece scores best, leftmost first. Its result for a prefix of a text ends in exactly
one token: of the pieces that end there, the one that is compatible with the last token of the prefix before it, that is, which
merging would keep apart from it. So one pass suffices: an Aho-Corasick automaton names the pieces that end at each character,
compatibility tests choose among them, and the table of last tokens is read backwards to recover the ids. Time follows the
length of a text, also where it has no blank.

Compatibility of two tokens depends on what grows at their seam only. Each token's own merges are known (`merged`); the pieces
at the seam, from single characters up, are walked in the order in which they come about, and the pair is incompatible if one
across the seam scores better than what is next on both sides. That order is the order of scores as long as no part of a token
scores worse than the token; for the few others (runs of blanks share one score) the pair is merged plainly. Answers are kept
by pair.

Texts are cut where no piece of the model holds the two characters side by side (letters before signs, digits, blanks behind a
word; found when a model is read, and a model whose pieces span blanks leaves texts uncut), so words come again and each worker
keeps a bounded number of them with their ids. Characters that no piece holds, line breaks among them, become byte tokens.

Models: BPE with byte fallback, no normalisation table, blanks kept and escaped, no user-defined or unused pieces; others are
refused. The file is a parameter. The driver reads it and sends its bytes (a model's size, whatever the table) to the workers.

Defined results: a null text is empty; an empty text is the begin and end ids, decoded as the empty string. Rows that repeat a
doc_id, or have none, are each encoded. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLANK = "▁"
UNKNOWN = -1
#: Words and pairs of tokens a worker remembers; past that it starts afresh.
WORDS_KEPT, PAIRS_KEPT, LONGEST_KEPT = 1 << 18, 1 << 20, 64
#: Kinds of pieces in the model file.
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6
BPE = 2
NEVER = 1 << 40


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message: integers as they are, all else as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class Vocabulary:
    """A model's pieces, which of them merging can reach, and which pairs it keeps apart."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        parts = list(fields(model))
        trainer, normaliser = (dict(fields(next((v for k, v in parts if k == n), b""))) for n in (2, 3))
        pieces = [dict(fields(v)) for k, v in parts if k == 1]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != BPE or not trainer.get(35) or trainer.get(24) or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("model: BPE with byte fallback, without normalisation table, user-defined or unused pieces, and with blanks kept")
        self.prefix = BLANK if normaliser.get(3, 1) else ""
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.of_byte = {int(p[1][3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == BYTE}
        self.texts = {i: p[1].decode() for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        scores = {i: float(np.frombuffer(pieces[i].get(2, bytes(4)), "<f4")[0]) for i in self.texts}
        places = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: The place of each piece by score; the first merges first.
        self.place = {self.texts[i]: places[scores[i]] for i in self.texts}
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.sizes = [len(self.texts.get(i, "")) for i in range(len(pieces))]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, text in self.texts.items():
            merged = self.merged(text)
            if len(merged) == 1:
                self.automaton.add_word(text, i)
                self.spines[i] = self._spines(merged[0])
        self.automaton.make_automaton()
        self.apart = _Apart(self)
        self.words = _Words(self)
        self.cut = self._cutter()

    def _cutter(self):
        """A function that cuts a text only between characters that no piece holds side by side."""
        if any(re.search(f"[^{BLANK}]{BLANK}", text) for text in self.texts.values()):
            return re.compile("(?s).+").findall
        beside = {pair for text in self.texts.values() for pair in zip(text, text[1:], strict=False)}
        loose: set[str] = set()  # letters and digits that some piece holds beside another sign

        def kind(c: str) -> str:
            return "other" if c in loose or not re.match(r"[^\W_]", c) else "digit" if re.match(r"\d", c) else "letter"

        while more := {c for a, b in beside if kind(b) == "digit" or a != BLANK and kind(a) != kind(b) for c in (a, b) if kind(c) != "other"}:
            loose |= more
        signs = re.escape("".join(sorted(loose)))
        digit = f"(?![{signs}])\\d" if loose else "\\d"
        return re.compile(f"{BLANK}*[^\\W\\d_{signs}]+|{digit}|{BLANK}*(?:[_{signs}]|[^\\w{BLANK}])+|{BLANK}+").findall

    def merged(self, text: str) -> list[tuple]:
        """What merging makes of a short text, as trees (text, left, right), by the definition."""
        row = [(c, None, None) for c in text]
        while len(row) > 1:
            best, at = min((self.place.get(row[i][0] + row[i + 1][0], NEVER), i) for i in range(len(row) - 1))
            if best == NEVER:
                break
            row[at : at + 2] = [(row[at][0] + row[at + 1][0], row[at], row[at + 1])]
        return row

    def _spines(self, tree: tuple) -> tuple[list, list] | None:
        """The pieces at the left and at the right end of a tree with their places, from the character up; None if a part merges after the whole."""

        def later(node: tuple) -> bool:
            return node[1] is not None and (any(x[1] is not None and self.place[x[0]] >= self.place[node[0]] for x in node[1:]) or later(node[1]) or later(node[2]))

        if later(tree):
            return None
        out = []
        for side in (1, 2):
            node, up = tree, []
            while node is not None:
                up.append((node[0], self.place[node[0]] if node[1] is not None else -1))
                node = node[side]
            out.append(up[::-1])
        return tuple(out)

    def kept_apart(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' characters gives the two tokens."""
        if self.spines[left] is None or self.spines[right] is None:
            return [t[0] for t in self.merged(self.texts[left] + self.texts[right])] == [self.texts[left], self.texts[right]]
        a, b = self.spines[left][1], self.spines[right][0]
        i = j = 0
        while True:
            over = self.place.get(a[i][0] + b[j][0], NEVER)
            next_a = a[i + 1][1] if i + 1 < len(a) else NEVER
            next_b = b[j + 1][1] if j + 1 < len(b) else NEVER
            # of equal scores the one further left comes first
            if over < next_a and over <= next_b and over < NEVER:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def ids_of(self, text: str) -> list[int]:
        """Ids of a text as it is, without begin and end."""
        # place -1 is the last one, which stands for the empty prefix until it is filled at the end
        last = [UNKNOWN] * (len(text) + 1) if len(text) <= LONGEST_KEPT else array("i", [UNKNOWN]) * (len(text) + 1)
        apart, sizes = self.apart, self.sizes
        for end, token in self.automaton.iter(text):
            if last[end] < 0:
                before = last[end - sizes[token]]
                if before < 0 or apart[before << 20 | token]:
                    last[end] = token
        out, at = [], len(text) - 1
        while at >= 0:
            token = last[at]
            if token < 0:
                out += [self.of_byte[b] for b in reversed(text[at].encode())]
                at -= 1
            else:
                out.append(token)
                at -= sizes[token]
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text with begin and end, as little-endian 32-bit integers."""
        words = self.cut((self.prefix + text).replace(" ", BLANK)) if text else []
        return np.frombuffer(b"".join([self.words.packed([self.bos]), *map(self.words.__getitem__, words), self.words.packed([self.eos])]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


class _Apart(dict):
    """kept_apart by pair, which is asked once."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, pair: int) -> bool:
        if len(self) >= PAIRS_KEPT:
            self.clear()
        self[pair] = found = self.vocabulary.kept_apart(pair >> 20, pair & (1 << 20) - 1)
        return found


class _Words(dict):
    """Ids of words as bytes, the latest ones and as many before them; long words are not kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word) or self.packed(self.vocabulary.ids_of(word))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


@functools.lru_cache(2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _worker(df: DataFrame, model: str, make, schema: T.StructType) -> DataFrame:
    """mapInArrow of make(vocabulary, id column, value column), a generator of batches."""
    sent = df.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                columns = make(known, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *(f.name for f in schema.fields[1:])])

    return df.mapInArrow(work, schema)


def _rows(docs: DataFrame, doc_id: str, value: str, kind: str, *columns: tuple[str, T.DataType]) -> tuple[DataFrame, T.StructType]:
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[value].cast(kind).alias("value"))
    return rows, T.StructType([rows.schema["doc_id"], *(T.StructField(*c) for c in columns)])


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row, with begin and end ids."""
    rows, schema = _rows(docs, doc_id, text, "string", ("ids", T.ArrayType(T.IntegerType())))

    def make(known: Vocabulary, column: pa.Array) -> list[pa.Array]:
        ids = [known.encode(x.as_py()) for x in column]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32), pa.int32()))]

    return _worker(rows, model, make, schema)


def decode(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; a null array is empty."""
    rows, schema = _rows(encoded, doc_id, ids, "array<int>", ("text", T.StringType()))

    def make(known: Vocabulary, column: pa.Array) -> list[pa.Array]:
        return [pa.array([known.library.decode(x.as_py() or []) for x in column], pa.string())]

    return _worker(rows, model, make, schema)


def digest(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded and decoded again in one pass."""
    rows, schema = _rows(docs, doc_id, text, "string", ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))

    def make(known: Vocabulary, column: pa.Array) -> list[pa.Array]:
        out = []
        for x in column:
            ids = known.encode(x.as_py())
            out.append((len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(known.decode(ids).encode()).hexdigest()))
        counts, ids_sha, texts_sha = zip(*out, strict=True)
        return [pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(texts_sha)]

    return _worker(rows, model, make, schema)
