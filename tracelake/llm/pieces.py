"""Operator 6: SentencePiece encoding and decoding on the tokenizers library.

``Model`` reads a SentencePiece model's protobuf and rebuilds it for the tokenizers
library: the normaliser (compiled character map, extra white space), the metaspace
marker and its dummy prefix, unigram scores or the merges that a BPE model's scores
order, and byte fallback.  No piece of such a model crosses from a word into the
marker behind it, so texts are split there first, which lets the library remember
words; a model with such pieces is not split.

``encode`` turns every text into ids, batch by batch, on several threads.  Parity with the
sentencepiece library is verified for all that texts are made of, and a text whose ids differ
gets that library's ids and parity false.  Where a model encodes each stretch from one
marker to the next by itself (no character map, no squeezing, a dummy prefix, no piece
that crosses a marker) a batch is that of the stretches which a task has not met yet,
so many to a line: both libraries encode the lines, which fall into their stretches at
the pieces that begin with a marker, and a text's ids are those of its stretches, in a
row.  There both libraries see stretches, in lines, not texts; the first texts of each task, and
all with control characters or a marker of their own, are encoded whole by both as well, and
sentencepiece's whole ids count.  Else whole texts are the batch.
``decode`` is the inverse.

Null texts have null ids and parity; empty texts have no ids, and an empty list decodes
to the empty text.  Decoding gives the normalised text back: with an identity normaliser
that is the text itself, unless it holds the marker U+2581, which reads as a space.
Repeated rows give equal rows, empty tables empty results; only the text is read, so
nulls in other columns and extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracelake.llm.textkit import share, trimmed

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_stretch = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts that are encoded whole too: with a marker of their own or control characters.
_odd = re.compile(f"[{MARK}\\x00-\\x08\\x0e-\\x1f\\x7f]")
#: Kinds of piece and of model in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
THREADS, CHUNK = 2, 64
#: Characters of distinct stretches whose ids a task remembers; then it forgets them all.
REMEMBERED = 2 << 20
#: Stretches to a line of a batch.
LINE = 256


def fields(data: bytes):
    """(number, value) of each field of a protobuf message; a value is an int or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind, size = tag & 7, 0
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """A SentencePiece model as read from its file, and its tokenizer."""

    def __init__(self, data: bytes):
        self.data = data
        pieces, spec, norm = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                x = dict(fields(value))
                pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        self.pieces = pieces
        self.kind, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        self.suffix = bool(spec.get(24, 0))
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = (bool(norm.get(i, 1)) for i in (3, 4, 5))
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        #: whether no piece crosses from a word into the marker behind it
        self.apart = not any(MARK in p.lstrip(MARK) for p, _, _ in pieces)
        if self.kind not in (UNIGRAM, BPE) or self.suffix or not self.escape or any(p[2] == USER for p in pieces):
            raise ValueError("only unigram and BPE models with a leading marker and without user-defined pieces are read")

    def merges(self) -> list[tuple[str, str]]:
        """The pairs that make each piece, in the order in which BPE joins them: by the joined piece's score."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        found = []
        for p, i in ids.items():
            pairs = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
            found += [(-self.pieces[i][1], i, ids[a], ids[b], a, b) for a, b in pairs]
        return [x[4:] for x in sorted(found)]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        unknown = self.pieces[self.unknown][0]
        if self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            made = models.BPE(vocab, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            made = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        out = Tokenizer(made)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
        if self.apart:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        return out

    def bytes_of(self) -> list[bytes]:
        """What each id decodes to: byte pieces to their byte, control pieces to nothing, the unknown piece to a sign."""
        by = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " \u2047 ".encode()}
        return [by.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in self.pieces]


class Codec:
    """Encoder and decoder of a worker; made once a task from the model's bytes."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = Model(data)
        self.fast = self.model.tokenizer()
        self.table = self.model.bytes_of()
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=data)
        m = self.model
        self.by_stretch = m.apart and m.dummy_prefix and not m.squeeze and not m.charsmap
        self.begins = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self.known: dict[str, bytes] = {}  # 4 bytes an id
        self.bad: set[str] = set()  # stretches that the libraries encode otherwise
        self.held = 0

    def _both(self, given: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both libraries."""
        return [e.ids for e in self.fast.encode_batch_fast(given, add_special_tokens=False)], self.plain.encode(given)

    def _learn(self, stretches: set[str]) -> None:
        """Have the ids of all these stretches at hand."""
        new = [x for x in stretches if x not in self.known]
        size = sum(map(len, new))
        if self.held + size > REMEMBERED:
            self.known.clear()
            new, self.held = list(stretches), 0
            size = sum(map(len, new))
        self.held += size
        plain_words = [x for x in new if len(x) > 1 and x[1] != MARK]
        alone = [x for x in new if len(x) == 1 or x[1] == MARK]
        groups = [plain_words[i : i + LINE] for i in range(0, len(plain_words), LINE)]
        for words, f, p in zip(groups, *self._both([" ".join(x[1:] for x in words) for words in groups])):
            f, p = np.array(f, dtype=np.int32), np.array(p, dtype=np.int32)
            begin = np.flatnonzero(self.begins[p]).tolist()
            if len(begin) != len(words) or not np.array_equal(f, p):  # told apart one by one
                alone += words
                continue
            ids = p.tobytes()
            for x, i, j in zip(words, begin, [*begin[1:], len(p)]):
                self.known[x] = ids[4 * i : 4 * j]
        # the first marker is set by the libraries; one with nothing behind it is told by what it adds to a letter
        skip = len(self.plain.encode("a"))
        for x, f, p in zip(alone, *self._both([x[1:] if len(x) > 1 else "a" + MARK for x in alone])):
            self.known[x] = np.array(p if len(x) > 1 else p[skip:], dtype=np.int32).tobytes()
            if f != p:
                self.bad.add(x)

    def encode(self, texts: list[str | None], whole: bool = False) -> list[tuple[np.ndarray | None, bool | None]]:
        """(ids, parity) of each text; whole has every text encoded whole by both libraries too."""
        given = [t or "" for t in texts]
        if not self.by_stretch:
            found = [(np.array(p, dtype=np.int32), f == p) for f, p in zip(*self._both(given))]
        else:
            parts = [_stretch.findall(MARK + t.replace(" ", MARK)) if t else [] for t in given]
            self._learn({x for every in parts for x in every})
            found = [(np.frombuffer(b"".join(map(self.known.__getitem__, every)), dtype=np.int32), not self.bad or self.bad.isdisjoint(every)) for every in parts]
            again = [i for i, t in enumerate(given) if whole or _odd.search(t)]
            for i, f, p in zip(again, *self._both([given[i] for i in again])):
                if found[i][0].tolist() != p or f != p:
                    found[i] = (np.array(p, dtype=np.int32), f == p)
        return [(None, None) if t is None else x for t, x in zip(texts, found)]

    def decode(self, ids: list[list[int] | None]) -> list[str | None]:
        out = []
        for x in ids:
            if x is None:
                out.append(None)
                continue
            data = b"".join(map(self.table.__getitem__, x))
            out.append((data[1:] if self.model.dummy_prefix and data[:1] == b" " else data).decode(errors="replace"))
        return out


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, threads: int = THREADS, ids: str = "ids", parity: str = "parity") -> DataFrame:
    """The rows with the columns ids (array of int) and parity (boolean) behind them.

    Columns of docs that are named so give way; to keep them, give other names.
    """
    docs = docs.drop(ids, parity)
    shared = share(docs.sparkSession, _model_bytes(model))  # half a MB
    i = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(parity, T.BooleanType())])

    def run(batches):
        codec, first = Codec(shared.value, threads), True
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                found = codec.encode(part.column(i).to_pylist(), whole=first)
                first = False
                cols = [pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([p for _, p in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, ids, parity])

    return docs.mapInArrow(trimmed(run), schema)


def decode(coded: DataFrame, model: str = MODEL, threads: int = THREADS, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with a column decoded behind them, from their column of ids; null ids decode to null.

    A column of that name gives way; to keep it, give another name.
    """
    coded = coded.drop(decoded)
    shared = share(coded.sparkSession, _model_bytes(model))
    i = coded.columns.index(ids)
    schema = T.StructType([*coded.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches):
        codec = Codec(shared.value, threads)
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                found = codec.decode(part.column(i).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, decoded])

    return coded.mapInArrow(trimmed(run), schema)


def round_trip(docs: DataFrame, model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as 4 bytes each, lowest first), round_trip and parity of each document.

    round_trip tells whether decoding the ids gives the text, null texts counting as
    empty.  Repeated rows give a row each; an empty table gives none.
    """
    shared = share(docs.sparkSession, _model_bytes(model))

    def run(batches):
        codec, first = Codec(shared.value, threads), True
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                given = [t or "" for t in part.column(1).to_pylist()]
                found = codec.encode(given, whole=first)
                first = False
                back = codec.decode([x.tolist() for x, _ in found])
                cols = [pa.array([len(x) for x, _ in found], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x, _ in found])]
                cols += [pa.array([t == g for t, g in zip(back, given)], pa.bool_()), pa.array([p for _, p in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_tokens", "ids_sha256", "round_trip", "parity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean")
