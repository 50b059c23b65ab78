"""Operator 13: which tokens of two tokenizers say the same bytes, and which go together most often.

A text (a space and the text, as both tokenizers see it) is encoded by a byte-level BPE
(side A) and by a SentencePiece model (side B).  Two tokens are linked where their byte
ranges overlap; where tokens of both sides end, a group ends.

1. ``code`` encodes.  Neither tokenizer joins anything across the place before a space or
   line break that follows a character other than white space, so texts fall into stretches
   there, and a task looks each stretch up that it has met.  A row keeps its pairs of linked
   ids and how often each occurs, as packed numbers a * (size of B) + b.
2. ``counted_pairs`` counts in how many documents each pair occurs.  A's ids are striped:
   id a is row a // stripes of stripe a % stripes, which spreads the frequent ids.  Tasks
   add up their own documents first; then the pairs of a stripe meet in the order of
   stripes, and one dense block (ROWS ids of A by all of B) is filled at a time with
   np.add.at.  The maximum of a block's row is the count of the best partners of that id.
3. ``align`` deals the documents' links by the same stripes, in the same tasks as the counts
   and behind them, so that one block serves all of a stripe.  A stripe with very many links
   is dealt to several tasks, each with the stripe's counts.  Sums go back to chunks of documents.

A task holds one block and one batch, whatever the number of documents; no dictionary of pairs is
ever sent to the driver or to all tasks.

Texts null or empty, or whose tokens' bytes are not the text's (those with U+2581, which
decodes as a space), have no tokens: zeros, and an empty digest.  Strings of special tokens are
text like any other.  Repeated rows are documents of their own.  Only doc_id, which may be
null, and text are read, so the names of other columns do not matter; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.pieces import MODEL, Model
from tracelake.llm.textkit import settle, share

BYTES_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Ids of A in a stripe: a block has so many rows, 8 bytes a cell.
ROWS = 64
#: Documents of a chunk, and the characters after which one ends sooner.
CHUNK, CHUNK_CHARS = 1024, 8 << 20
#: Stretches that a task remembers, and their characters; then it forgets them all.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8 << 20
#: Stretches to a line of what is encoded at once.
LINE = 512
#: Pairs that a task adds up before it hands them on, links of a stripe to a task, bytes of sums that a task holds.
HELD, LINKS, SUMS = 1 << 20, 1 << 26, 32 << 20
_stretch = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class Aligner:
    """Both tokenizers; made once a task from their files' bytes."""

    def __init__(self, bytes_model: bytes, pieces_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        spec, model = json.loads(bytes_model), Model(pieces_model)
        self.a = Tokenizer.from_str(bytes_model.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces_model)
        alphabet, added = byte_alphabet(), {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        a = [added.get(i, b"") for i in range(self.a.get_vocab_size())]
        for token, i in spec["model"]["vocab"].items():
            a[i] = added.get(i) or bytes(alphabet[c] for c in token)
        self.bytes_a, self.bytes_b = a, model.bytes_of()
        self.len_a, self.len_b = np.array([len(x) for x in a]), np.array([len(x) for x in self.bytes_b])
        first = spec.get("pre_tokenizer") or {}
        regular = spec.get("normalizer") is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
        if not model.dummy_prefix:
            raise ValueError("the SentencePiece model must put a space before a text")
        #: whether texts fall into stretches; else they are encoded whole
        self.by_stretch = regular and model.apart and not model.squeeze and not model.charsmap and not any("\n" in p for p, *_ in model.pieces)
        self.skip = len(self.b.encode("a"))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.said: list[str] = []  # groups of a stretch
        self.pairs = np.zeros(1 << 16, dtype=np.int64)  # of all stretches, one behind the other
        self.ends = np.zeros(1, dtype=np.int64)  # where a stretch's pairs end
        self.sizes = np.zeros((0, 4), dtype=np.int64)  # tokens of A and B, groups, links
        self.sound = np.zeros(0, dtype=bool)  # whether bytes agree

    def encode(self, lines: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of A and of B of lines that begin with a space or a line break."""
        a = [e.ids for e in self.a.encode_batch_fast(lines, add_special_tokens=False)]
        # the library puts a space before a line: that is the line's own, or one too many;
        # a space with nothing behind it is told by what it adds to a letter
        b = self.b.encode(["a " if x == " " else x[1:] if x[0] == " " else x for x in lines], num_threads=1)
        return a, [y[self.skip :] if x == " " else y if x[0] == " " else y[1:] for x, y in zip(lines, b)]

    def _keep(self, new: list[str], sizes: np.ndarray, pairs: np.ndarray, said: list[str], sound: bool) -> None:
        self.known.update(zip(new, range(len(self.said), len(self.said) + len(new))))
        self.said += said
        ends = self.ends[-1] + np.cumsum(sizes[:, 3])
        while len(self.pairs) < ends[-1]:
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.pairs[self.ends[-1] : ends[-1]] = pairs
        self.ends, self.sizes = np.concatenate([self.ends, ends]), np.concatenate([self.sizes, sizes])
        self.sound = np.concatenate([self.sound, np.full(len(new), sound)])

    def _learn(self, new: list[str], apart: bool = False) -> None:
        """Have the links and groups of these stretches at hand.

        Stretches that end in a character, not in white space, are tokenized alike one behind the
        other, so many to a line; apart encodes each by itself.
        """
        if not apart and self.by_stretch:
            alone = [x for x in new if x[-1].isspace()]
            new = [x for x in new if not x[-1].isspace()]
            lines = ["".join(new[i : i + LINE]) for i in range(0, len(new), LINE)]
            if alone:
                self._learn(alone, True)
        else:
            lines = new
        if not new:
            return
        found_a, found_b = self.encode(lines)
        a, b = (np.fromiter(itertools.chain.from_iterable(x), dtype=np.int64) for x in (found_a, found_b))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        stops = np.cumsum([len(x.encode()) for x in new])
        data = "".join(lines).encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != data or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != data or not (np.isin(stops, end_a).all() and np.isin(stops, end_b).all()):
            if len(new) > 1:  # some stretch's bytes are not its tokens': it is found by halves
                self._learn(new[: len(new) // 2], apart)
                self._learn(new[len(new) // 2 :], apart)
            elif not apart:
                self._learn(new, True)
            else:
                self._keep(new, np.zeros((1, 4), dtype=np.int64), np.zeros(0, dtype=np.int64), [""], False)
            return
        # both sides tile the same bytes, so each piece between two ends of either is one link
        ends, both = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b)
        pairs = a[np.searchsorted(end_a, ends)] * len(self.bytes_b) + b[np.searchsorted(end_b, ends)]
        cut_a, cut_b = np.searchsorted(end_a, both, "right").tolist(), np.searchsorted(end_b, both, "right").tolist()
        a, b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups = [f"{a[i] if j - i == 1 else ','.join(a[i:j])}|{b[k] if m - k == 1 else ','.join(b[k:m])}" for i, j, k, m in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b)]
        upto = np.stack([np.searchsorted(x, stops, "right") for x in (end_a, end_b, both, ends)], axis=1)
        at = upto[:, 2].tolist()
        said = [";".join(groups[i:j]) for i, j in zip([0, *at], at)]
        self._keep(new, np.diff(upto, axis=0, prepend=0), pairs, said, True)

    def code_all(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray] | None]:
        """(tokens of A, of B, groups, links, digest of the groups, pairs in order, how often each) of each text; None where it has no tokens."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        parts = [(_stretch.findall(" " + t) if self.by_stretch else [" " + t]) if t else [] for t in texts]
        new = [s for s in dict.fromkeys(itertools.chain.from_iterable(parts)) if s not in self.known]
        self.chars += sum(map(len, new))
        self._learn(new)
        at = [list(map(self.known.__getitem__, p)) for p in parts]
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in at])
        every = np.fromiter(itertools.chain.from_iterable(at), dtype=np.int64, count=len(doc))
        has = np.bincount(doc, minlength=len(texts)) > 0
        has[doc[~self.sound[every]]] = False
        doc, every = doc[has[doc]], every[has[doc]]
        total = np.stack([np.bincount(doc, self.sizes[every, i], len(texts)) for i in range(4)], axis=1).astype(np.int64).tolist()
        # the distinct stretches of each text, then the distinct pairs of these
        kinds, often = np.unique(doc * len(self.said) + every, return_counts=True)
        doc, every = np.divmod(kinds, max(1, len(self.said)))
        n = self.sizes[every, 3]
        place = np.repeat(self.ends[every] - np.cumsum(n) + n, n) + np.arange(n.sum())
        space = len(self.bytes_a) * len(self.bytes_b)
        pairs, same = np.unique(np.repeat(doc, n) * space + self.pairs[place], return_inverse=True)
        times = np.bincount(same, np.repeat(often, n), len(pairs)).astype(np.int64)
        doc, pairs = np.divmod(pairs, space)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = []
        for i, stretches in enumerate(at):
            if not has[i]:
                out.append(None)
                continue
            digest = hashlib.sha256(";".join(map(self.said.__getitem__, stretches)).encode()).hexdigest()
            out.append((*total[i], digest, pairs[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]))
        return out

    def code(self, text: str | None):
        return self.code_all([text])[0]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def code(docs: DataFrame, bytes_model: str = BYTES_MODEL, pieces_model: str = MODEL) -> DataFrame:
    """(chunk, at, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row.

    chunk and at tell rows apart; pairs and times hold 8 and 4 bytes a pair, lowest byte first.
    """
    shared = share(docs.sparkSession, (_read(bytes_model), _read(pieces_model)))  # some MB, whatever the input
    kind = docs.schema["doc_id"].dataType
    names = ["chunk", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches):
        aligner, chunk, at, chars = Aligner(*shared.value), TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            for begin in range(0, b.num_rows, 64):
                part, rows = b.slice(begin, 64), []
                given = part.column(1).to_pylist()
                for text, x in zip(given, aligner.code_all(given)):
                    if at and (at == CHUNK or chars >= CHUNK_CHARS):
                        chunk, at, chars = chunk + 1, 0, 0
                    rows.append((chunk, at, *x[:5], x[5].astype("<i8").tobytes(), x[6].astype("<u4").tobytes()) if x else (chunk, at, 0, 0, 0, 0, "", b"", b""))
                    at, chars = at + 1, chars + len(text or "")
                c = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
                c = [pa.array(x, t) for x, t in zip(c, kinds)]
                yield pa.RecordBatch.from_arrays([c[0], c[1], part.column(0), *c[2:]], names)

    schema = f"chunk long, at int, doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _by_stripe(pairs: np.ndarray, stripes: int, width: int):
    """(stripe, places in pairs, cells of the stripe's block) for each stripe that has some of the pairs."""
    a, b = np.divmod(pairs, width)
    stripe, row = a % stripes, a // stripes
    order = np.argsort(stripe, kind="stable")
    edges = np.flatnonzero(np.diff(stripe[order], prepend=-1))
    for i, j in zip(edges, [*edges[1:], len(order)]):
        at = order[i:j]
        yield int(stripe[at[0]]), at, (row[at] * width + b[at]).astype("<u4")


class _Block:
    """The dense counts of the stripe that a task is at; rows that nothing has touched are neither cleared nor searched."""

    def __init__(self, width: int):
        self.stripe, self.cells = None, np.zeros((ROWS, width), dtype=np.int64)
        self.width, self.touched = width, np.zeros(ROWS, dtype=bool)

    def turn(self, stripe) -> None:
        """Go to a stripe: an empty block, if it is another than before."""
        if stripe != self.stripe:
            self.cells[self.touched] = 0
            self.touched[:] = False
            self.stripe = stripe

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        np.add.at(self.cells.ravel(), cells, counts)
        self.touched[cells // self.width] = True

    def filled(self) -> tuple[np.ndarray, np.ndarray]:
        """The cells that hold a count, and the counts."""
        rows = np.flatnonzero(self.touched)
        at, column = np.nonzero(self.cells[rows])
        return rows[at] * self.width + column, self.cells[rows[at], column]

    def best(self) -> np.ndarray:
        """The highest count of each row."""
        top = np.zeros(ROWS, dtype=np.int64)
        top[self.touched] = self.cells[self.touched].max(axis=1)
        return top


def counted_pairs(coded: DataFrame, width: int, stripes: int) -> DataFrame:
    """(stripe, cells, counts): in how many rows each pair of ids occurs, HELD pairs to a row at most; width is the number of B's ids."""

    def add_up(batches):
        pairs, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def hand_on():
            rows = [(s, cells.tobytes(), counts[at].astype("<i8").tobytes()) for s, at, cells in _by_stripe(pairs, stripes, width)]
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 256]), (pa.int32(), pa.binary(), pa.binary()))], ["stripe", "cells", "counts"])

        for b in batches:
            for begin in range(0, b.num_rows, 256):
                more = [np.frombuffer(x, dtype="<i8") for x in b.column(0).slice(begin, 256).to_pylist()]
                given = np.concatenate([pairs, *more])
                weight = np.concatenate([counts, np.ones(len(given) - len(pairs), dtype=np.int64)])
                pairs, same = np.unique(given, return_inverse=True)
                counts = np.zeros(len(pairs), dtype=np.int64)
                np.add.at(counts, same, weight)
                if len(pairs) >= HELD:
                    yield from hand_on()
                    pairs, counts = pairs[:0], counts[:0]
        yield from hand_on()

    def fill(batches):
        block = _Block(width)

        def done():
            cells, counts = block.filled()
            for i in range(0, len(cells), HELD):
                x, n = cells[i : i + HELD].astype("<u4").tobytes(), counts[i : i + HELD].astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block.stripe], pa.int32()), pa.array([x]), pa.array([n])], ["stripe", "cells", "counts"])

        for b in batches:
            for stripe, cells, counts in zip(*(c.to_pylist() for c in b.columns)):
                if block.stripe not in (None, stripe):
                    yield from done()
                block.turn(stripe)
                block.add(np.frombuffer(cells, dtype="<u4"), np.frombuffer(counts, dtype="<i8"))
        if block.stripe is not None:
            yield from done()

    schema = "stripe int, cells binary, counts binary"
    summed = coded.where(F.length("pairs") > 0).select("pairs").mapInArrow(add_up, schema)
    return summed.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(fill, schema)


def _links(coded: DataFrame, width: int, stripes: int) -> DataFrame:
    """(chunk, stripe, cells, rows, times): the links of a chunk's documents, by stripe."""
    names = ["chunk", "stripe", "cells", "rows", "times"]

    def run(batches):
        def hand_on(chunk, held):
            pairs = np.concatenate([p for _, p, _ in held])
            rows = np.repeat(np.array([r for r, _, _ in held], dtype="<u2"), [len(p) for _, p, _ in held])
            times = np.concatenate([t for _, _, t in held])
            out = [(chunk, s, cells.tobytes(), rows[at].tobytes(), times[at].tobytes()) for s, at, cells in _by_stripe(pairs, stripes, width)]
            for i in range(0, len(out), 256):
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 256]), kinds)], names)

        last, held, size = None, [], 0
        for b in batches:
            for chunk, row, pairs, times in zip(*(c.to_pylist() for c in b.columns)):
                if held and (chunk != last or size >= HELD):
                    yield from hand_on(last, held)
                    held, size = [], 0
                last = chunk
                held.append((row, np.frombuffer(pairs, dtype="<i8"), np.frombuffer(times, dtype="<u4")))
                size += len(pairs) // 8
        if held:
            yield from hand_on(last, held)

    given = coded.where(F.length("pairs") > 0).select("chunk", "at", "pairs", "times")
    return given.mapInArrow(run, "chunk long, stripe int, cells binary, rows binary, times binary")


def _scored(links: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """(chunk, at, n_best, count_sum) of each document that has links."""
    size = counts.select("stripe", "counts").groupBy("stripe").agg(F.count("*").alias("x"))
    entries = links.groupBy("stripe").agg(F.sum(F.length("rows") / 2).alias("n"))
    # a row for each stripe: fewer than A has ids
    parts = size.join(entries, "stripe").select("stripe", F.ceil(F.col("n") / LINKS).cast("int").alias("parts"))
    parts = F.broadcast(settle(parts, "align-stripes"))
    empty = F.lit(None).cast("binary")
    known = counts.join(parts, "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("chunk"), "cells", "counts", empty.alias("rows"), empty.alias("times"))
    asked = links.join(parts, "stripe").select("stripe", F.pmod(F.xxhash64("chunk"), "parts").cast("int").alias("part"), "chunk", "cells", empty.alias("counts"), "rows", "times")
    dealt = known.unionByName(asked).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "chunk")

    def score(batches):
        block, best, sums = _Block(width), None, {}

        def hand_on():
            keys = list(sums)
            for i in range(0, len(keys), 256):
                some = keys[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([sums[k].tobytes() for k in some])], ["chunk", "sums"])
            sums.clear()

        for b in batches:
            for stripe, part, chunk, cells, counts, rows, times in zip(*(c.to_pylist() for c in b.columns)):
                cells = np.frombuffer(cells, dtype="<u4")
                if (stripe, part) != block.stripe:
                    block.turn((stripe, part))
                    best = None
                if chunk < 0:  # the counts of a part come before its links
                    block.add(cells, np.frombuffer(counts, dtype="<i8"))
                    continue
                if best is None:
                    best = block.best()
                n, rows, times = block.cells.ravel()[cells], np.frombuffer(rows, dtype="<u2"), np.frombuffer(times, dtype="<u4").astype(np.int64)
                if chunk not in sums:
                    if len(sums) * CHUNK * 16 >= SUMS:
                        yield from hand_on()
                    sums[chunk] = np.zeros((CHUNK, 2), dtype="<i8")
                np.add.at(sums[chunk][:, 0], rows, times * (n == best[cells // width]))
                np.add.at(sums[chunk][:, 1], rows, times * n)
        yield from hand_on()

    def total(table):
        chunk = table["chunk"][0].as_py()
        both = sum(np.frombuffer(x, dtype="<i8") for x in table["sums"].to_pylist()).reshape(-1, 2)
        return pa.table({"chunk": pa.array([chunk] * len(both), pa.int64()), "at": pa.array(np.arange(len(both), dtype=np.int32)), "n_best": both[:, 0], "count_sum": both[:, 1]})

    # a chunk comes once from each task that has links of it, a few KB each
    return dealt.mapInArrow(score, "chunk long, sums binary").groupBy("chunk").applyInArrow(total, "chunk long, at int, n_best long, count_sum long")


def align(docs: DataFrame, bytes_model: str = BYTES_MODEL, pieces_model: str = MODEL) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    n_best counts the links whose pair is as frequent as any of its A id, count_sum adds the
    counts of all links; a pair's count is the number of rows that hold it linked.
    """
    model = Model(_read(pieces_model))
    width = len(model.pieces)
    stripes = -(-len(_vocabulary(bytes_model)) // ROWS)
    coded = settle(code(docs, bytes_model, pieces_model), "align-coded")
    counts = settle(counted_pairs(coded, width, stripes), "align-counts")
    links = settle(_links(coded, width, stripes), "align-links")
    sums = _scored(links, counts, width)
    rows = coded.drop("pairs", "times").join(sums, ["chunk", "at"], "left")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"), F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256")


def pair_counts(docs: DataFrame, bytes_model: str = BYTES_MODEL, pieces_model: str = MODEL) -> DataFrame:
    """(a, b, n, best): every pair of ids that some document links, in how many, and whether it is among the most frequent of a."""
    width = len(Model(_read(pieces_model)).pieces)
    stripes = -(-len(_vocabulary(bytes_model)) // ROWS)
    counts = counted_pairs(settle(code(docs, bytes_model, pieces_model), "align-coded"), width, stripes)

    def unpack(batches):
        for b in batches:
            for stripe, cells, n in zip(*(c.to_pylist() for c in b.columns)):
                row, y = np.divmod(np.frombuffer(cells, dtype="<u4").astype(np.int64), width)
                yield pa.RecordBatch.from_arrays([pa.array(row * stripes + stripe), pa.array(y), pa.array(np.frombuffer(n, dtype="<i8"))], ["a", "b", "n"])

    rows = counts.mapInArrow(unpack, "a long, b long, n long")
    top = rows.groupBy("a").agg(F.max("n").alias("top"))
    return rows.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _vocabulary(bytes_model: str) -> dict:
    spec = json.loads(_read(bytes_model))
    return spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
