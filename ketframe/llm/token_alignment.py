"""Alignment of the tokens of two tokenizers by a sweep over their end events.

Both tokenizers cut the same bytes (a space and the text). Each token is an event at the offset of its last byte. The
events of A and of B are one table, in runs: a row holds one side's token ids whose ends lie in one SPAN of bytes of one
document; ends follow from the ids, since each tokenizer's byte lengths are known. The table is repartitioned by
document and sorted within partitions by offset and side, and a machine streams through it. Its state is what the
last common end has left open: the tokens of A and of B behind it. Every interval between neighbouring events lies
in one token of A and one of B, which is a link; an event of both sides ends a group.

The count of a pair of ids is the number of documents that hold it linked: pairs are distinct by document in the sweep,
counted by task, then added by pair. Counts return to the documents' packed pairs in blocks of LOOKUP pairs, each of
which goes to every task once; a corpus with more pairs takes more passes over the packed pairs, not more memory.

Both sides are segmented by a table of distinct chunks a task holds (emptied at TABLE_CHUNKS): a space between two
characters that are none starts a chunk, which no token of either side crosses (checked for B's pieces; A has to be a
byte-level BPE with the usual split pattern). Otherwise, or where a chunk does not give its own bytes back, the whole
text goes to the libraries.

Defined cases: every row is a document of its own, rows that agree too; a null or empty text, and one whose joined
bytes differ on either side, has no tokens, so zeros and an empty digest; null ids pass; other columns are not read.
Rows are told apart by their place in the input's partitions, so the input has to come in the same order when a
task runs again, as files do.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import bounded_batches, documents, materialize
from ketframe.llm.sentencepiece import MARK, pieces_respect_markers

#: Bytes of a document that one run of events covers.
SPAN = 1 << 15
TABLE_CHUNKS = 400_000
CALL_CHUNKS = 20_000
#: New chunks that go to the libraries as one text.
JOINED = 64
#: Pairs of ids with their counts that go to every task at once.
LOOKUP = 2_000_000
#: Pairs that a task counts before it gives them away.
TASK_PAIRS = 2_000_000

EVENTS = "row long, doc_id long, at long, side int, ids binary"
SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary"
ALIGNED = "row long, doc_id long, at long, a array<int>, b array<int>, group_ends array<long>, links array<struct<a: int, b: int>>"

_CHUNK = re.compile("(?<! ) (?! )")


def pack(v: np.ndarray) -> bytes:
    """Whole numbers from 0 on: the width of the largest, then the bytes by significance, compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(v) or w == 8 or int(v.max()) < 1 << 8 * w)
    planes = v.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(np.int64)


def byte_level_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where it prints, else the next from U+0100 on."""
    out, free = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


class Tokenizers:
    """Both tokenizers in a task, and the bytes of their tokens."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_a, self.bytes_b = vocabulary_bytes(self.a, self.b)
        self.sizes = [np.array([len(x) for x in v]) for v in (self.bytes_a, self.bytes_b)]
        split = json.loads(a).get("pre_tokenizer") or {}
        self.by_chunk = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not json.loads(a).get("normalizer") and pieces_respect_markers(self.b)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of A and B of each text, and whether both sides' bytes are a space and the text."""
        found = zip(texts, self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1))
        out = []
        for text, a, b in found:
            want = b" " + text.encode()
            out.append((a.ids, b, b"".join([self.bytes_a[i] for i in a.ids]) == want == b"".join([self.bytes_b[i] for i in b])))
        return out

    def encode_chunks(self, found: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each chunk: whether both sides' bytes are a space and the chunk; and for A and B all ids in a row, and how many each chunk has.

        JOINED chunks go to the libraries as one text, and its ids are cut where the chunks end. A text with an empty chunk (two meet
        in one token of spaces), that does not fall into these chunks again, or whose bytes or ends differ, is encoded chunk by chunk.
        """
        groups = [found[at : at + JOINED] for at in range(0, len(found), JOINED)]
        texts = [" ".join(g) for g in groups]
        both = zip((x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)), self.b.encode(texts, num_threads=1))
        good, ids, many = [], ([], []), ([], [])
        for group, text, pair in zip(groups, texts, both):
            cut = self._cut(group, text, pair)
            if cut is None:
                alone = self.encode(group)
                good.append(np.array([x[2] for x in alone], bool))
                pair = [[i for x in alone for i in x[side]] for side in range(2)]
                cut = [np.array([len(x[side]) for x in alone], np.int64) for side in range(2)]
            else:
                good.append(np.ones(len(group), bool))
            for side in range(2):
                ids[side].append(np.array(pair[side], np.int32))
                many[side].append(cut[side])
        return np.concatenate(good), [np.concatenate(x) for x in ids], [np.concatenate(x) for x in many]

    def _cut(self, group: list[str], text: str, pair: tuple[list[int], list[int]]) -> list[np.ndarray] | None:
        """How many of a joined text's ids each chunk has on either side; None where that cannot be told."""
        if "" in group or chunks(text) != group:
            return None
        want = b" " + text.encode()
        ends = np.cumsum([len(c) for c in group] if text.isascii() else [len(c.encode()) for c in group]) + np.arange(1, len(group) + 1)
        out = []
        for ids, data, size in zip(pair, (self.bytes_a, self.bytes_b), self.sizes):
            size = size[ids]
            at = np.cumsum(size)
            last = np.searchsorted(at, ends)
            if not size.all() or b"".join(map(data.__getitem__, ids)) != want or (at[last] != ends).any():
                return None
            out.append(np.diff(last + 1, prepend=0))
        return out


def vocabulary_bytes(a, b) -> tuple[list[bytes], list[bytes]]:
    alphabet = byte_level_alphabet()
    of_a = [b""] * a.get_vocab_size()
    for entry, i in a.get_vocab().items():
        of_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(MARK, " ").encode() for i in range(b.get_piece_size())]
    return of_a, of_b


class ChunkTable(dict):
    """Chunk -> row of the table; new chunks wait in `pending` until `segment`."""

    def __init__(self, both: Tokenizers):
        super().__init__()
        self.both, self.pending = both, []
        self.good = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32)] * 2
        self.start, self.size = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2

    def __missing__(self, chunk: str) -> int:
        self.pending.append(chunk)
        self[chunk] = row = len(self)
        return row

    def segment(self) -> None:
        if not self.pending:
            return
        found = [self.both.encode_chunks(self.pending[at : at + CALL_CHUNKS]) for at in range(0, len(self.pending), CALL_CHUNKS)]
        self.pending = []
        self.good = np.concatenate([self.good, *(x[0] for x in found)])
        for side in range(2):
            size = np.concatenate([x[2][side] for x in found])
            self.start[side] = np.concatenate([self.start[side], len(self.ids[side]) + np.cumsum(size) - size])
            self.ids[side] = np.concatenate([self.ids[side], *(x[1][side] for x in found)])
            self.size[side] = np.concatenate([self.size[side], size])

    def joined(self, rows: np.ndarray, side: int) -> np.ndarray:
        size = self.size[side][rows]
        first = np.cumsum(size) - size
        return self.ids[side][np.repeat(self.start[side][rows] - first, size) + np.arange(int(size.sum()))]


def chunks(text: str) -> list[str]:
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return _CHUNK.split(text)


def encode_texts(table: ChunkTable, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids of both sides of each text; none on either side where the bytes differ."""
    nothing = np.zeros(0, np.int64)
    plain = [t if t and MARK not in t else None for t in texts]  # a marker in a text comes back as a space
    rows = [np.fromiter(map(table.__getitem__, chunks(t)), np.int64) if t and table.both.by_chunk else None for t in plain]
    table.segment()
    out = []
    for text, at in zip(plain, rows):
        if not text:
            out.append((nothing, nothing))
        elif at is not None and table.good[at].all():
            out.append((table.joined(at, 0), table.joined(at, 1)))
        else:
            a, b, good = table.both.encode([text])[0]
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if good else (nothing, nothing))
    return out


def token_events(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The events of both sides in runs, see EVENTS. Every span of a document has a row of each side, and every document a span."""
    a, b = Path(a_path).read_text(), Path(b_path).read_bytes()
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = Tokenizers(a, b)
        sizes = [np.array([len(x) for x in v]) for v in (both.bytes_a, both.bytes_b)]
        table = ChunkTable(both)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin in range(0, len(texts), 64):
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist()[begin : begin + 64], encode_texts(table, texts[begin : begin + 64])):
                    last = [(np.cumsum(size[i]) - 1) // SPAN for size, i in zip(sizes, ids)]
                    for k in range(1 + max((int(x[-1]) for x in last if len(x)), default=0)):
                        rows += [(row, doc_id, k * SPAN, side, pack(i[np.searchsorted(x, k) : np.searchsorted(x, k + 1)])) for side, (i, x) in enumerate(zip(ids, last))]
                    row += 1
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["row", "doc_id", "at", "side", "ids"])
                if len(table) > TABLE_CHUNKS:
                    table = ChunkTable(both)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, EVENTS)


class Piece(NamedTuple):
    """What a step of the machine closes: whole groups."""

    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    ends: np.ndarray  # of links, whether the group ends there
    offsets: np.ndarray  # where links end, from the last group's end on


class Sweep:
    """The machine: open tokens of each side behind the last common end."""

    def __init__(self, sizes: list[np.ndarray]):
        self.sizes = sizes
        self.clear()

    def clear(self) -> None:
        self.open = [np.zeros(0, np.int64)] * 2

    def step(self, a: np.ndarray, b: np.ndarray) -> Piece:
        """Events of one more span of both sides."""
        a, b = ids = [np.concatenate(x) if len(x[0]) else x[1] for x in zip(self.open, (a, b))]
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids)]
        marks = np.zeros(max((int(e[-1]) for e in ends if len(e)), default=0) + 1, np.uint8)
        marks[ends[0]] = 1
        marks[ends[1]] += 2
        at = np.flatnonzero(marks)
        kind = marks[at]
        both = kind == 3
        closed = len(both) - int(both[::-1].argmax()) if both.any() else 0
        at, kind, both = at[:closed], kind[:closed], both[:closed]
        in_a, in_b = kind & 1, kind >> 1
        link_a, link_b = np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b
        n_a, n_b = (int(link_a[-1]) + 1, int(link_b[-1]) + 1) if closed else (0, 0)
        self.open = [a[n_a:], b[n_b:]]
        return Piece(a[:n_a], b[:n_b], link_a, link_b, both, at)


class Digest:
    """SHA-256 of `a1,a2|b1;a3|b2,b3`, piece by piece."""

    def __init__(self, sizes: list[np.ndarray]):
        self.n = [len(s) for s in sizes]
        words = [f"{i}{mark}".encode() for n, marks in zip(self.n, (",|", ",;")) for mark in marks for i in range(n)]
        self.size = np.array([len(w) for w in words])
        self.start = np.cumsum(self.size) - self.size
        self.words = np.frombuffer(b"".join(words), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, p: Piece) -> None:
        if not len(p.ends):
            return
        end_a, end_b = p.link_a[p.ends] + 1, p.link_b[p.ends] + 1  # of groups
        before_b = np.r_[0, end_b[:-1]]
        codes = np.empty(len(p.a) + len(p.b), np.int64)
        of_a, of_b = (np.repeat(np.arange(len(e)), np.diff(e, prepend=0)) for e in (end_a, end_b))
        place_a, place_b = np.arange(len(p.a)) + before_b[of_a], np.arange(len(p.b)) + end_a[of_b]
        codes[place_a] = p.a
        codes[place_b] = 2 * self.n[0] + p.b
        codes[place_a[end_a - 1]] += self.n[0]
        codes[place_b[end_b - 1]] += self.n[1]
        size = self.size[codes]
        ends = np.cumsum(size)
        text = self.words[np.repeat(self.start[codes] - ends + size, size) + np.arange(ends[-1])]
        self.sha.update((b";" if self.any else b"") + text[:-1].tobytes())
        self.any = True

    def hex(self) -> str:
        return self.sha.hexdigest() if self.any else ""


def _pieces(batches: Iterator[pa.RecordBatch], machine: Sweep) -> Iterator[tuple[int, int | None, int, Piece, bool]]:
    """(row, doc_id, at, piece, whether the document begins) of sorted events."""
    held, now = None, None
    for batch in batches:
        for row, doc_id, at, side, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if side == 0:
                held = unpack(data)
                continue
            begins = row != now
            if begins:
                machine.clear()
                now = row
            yield row, doc_id, at, machine.step(held, unpack(data)), begins


def _sorted(events: DataFrame) -> DataFrame:
    return events.repartition("row").sortWithinPartitions("row", "at", "side")


def _sizes(a_path: str, b_path: str) -> list[np.ndarray]:
    both = Tokenizers(Path(a_path).read_text(), Path(b_path).read_bytes())
    return [np.array([len(x) for x in v]) for v in (both.bytes_a, both.bytes_b)]


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups and links of every document in runs, see ALIGNED.

    a, b: the ids that the run closes; links: pairs of places in them; group_ends: byte offsets in the space and the
    text. `row` tells documents apart, `at` orders a document's runs.
    """
    sizes = _sizes(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 0
        for row, doc_id, at, p, begins in _pieces(batches, Sweep(sizes)):
            base = 0 if begins else base
            ends = base + p.offsets[p.ends]
            base = int(ends[-1]) if len(ends) else base
            links = [{"a": x, "b": y} for x, y in zip(p.link_a.tolist(), p.link_b.tolist())]
            values = [row, doc_id, at, p.a.tolist(), p.b.tolist(), ends.tolist(), links]
            ints = pa.list_(pa.int32())
            kinds = [pa.int64(), pa.int64(), pa.int64(), ints, ints, pa.list_(pa.int64()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names=["row", "doc_id", "at", "a", "b", "group_ends", "links"])

    return _sorted(token_events(df, a_path, b_path, id_col, text_col)).mapInArrow(run, ALIGNED)


class Tally:
    """Sorted distinct codes with their number, merged whenever `room` codes wait."""

    def __init__(self, room: int):
        self.room = room
        self.clear()

    def clear(self) -> None:
        self.codes, self.n, self.held, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, codes: np.ndarray) -> None:
        self.held.append(codes)
        self.waiting += len(codes)
        if self.waiting > self.room:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        more, times = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.waiting = [], 0
        if not len(self.codes):
            self.codes, self.n = more, times
            return
        found = np.concatenate([self.codes, more])
        order = np.argsort(found, kind="stable")
        found, times = found[order], np.concatenate([self.n, times])[order]
        first = np.flatnonzero(np.diff(found, prepend=-1))
        self.codes, self.n = found[first], np.add.reduceat(times, first)


def sweep(events: DataFrame, sizes: list[np.ndarray]) -> DataFrame:
    """One row a document, see SWEPT: counts, digest of groups, its distinct pairs of linked ids (packed steps) and their links."""
    width = len(sizes[1])
    kinds = [*[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, tally, out = Digest(sizes), Tally(TASK_PAIRS), []
        head, counts = None, [0, 0, 0, 0]

        def close() -> None:
            if head is not None:
                tally.settle()
                out.append((*head, *counts, digest.hex(), pack(np.diff(tally.codes, prepend=0)), pack(tally.n)))

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=[c.split()[0] for c in SWEPT.split(", ")])
            out.clear()
            return batch

        for row, doc_id, _, p, begins in _pieces(batches, Sweep(sizes)):
            if begins:
                close()
                head, counts = (row, doc_id), [0, 0, 0, 0]
                digest.clear()
                tally.clear()
                if len(out) >= 256:
                    yield rows()
            digest.add(p)
            counts = [x + int(y) for x, y in zip(counts, (len(p.a), len(p.b), p.ends.sum(), len(p.ends)))]
            tally.add(p.a[p.link_a] * width + p.b[p.link_b])
        close()
        if out:
            yield rows()

    return _sorted(events).mapInArrow(run, SWEPT)


def pair_counts(swept: DataFrame, width: int) -> DataFrame:
    """(a, pair, n, best): the documents of each pair of ids, and whether no pair of its A id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(TASK_PAIRS)

        def rows() -> Iterator[pa.RecordBatch]:
            tally.settle()
            for at in range(0, len(tally.codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 100_000]) for v in (tally.codes, tally.n)], names=["pair", "n"])
            tally.clear()

        for batch in batches:
            for data in batch.column(0).to_pylist():
                tally.add(np.cumsum(unpack(data)))
            if len(tally.codes) > TASK_PAIRS:
                yield from rows()
        yield from rows()

    counts = swept.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.select(F.expr(f"pair div {width}").alias("a"), "pair", "n"), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A
    return materialize(counts.join(most, "a").select("a", "pair", "n", (F.col("n") == F.col("most")).alias("best")), "best")


def with_counts(swept: DataFrame, counts: DataFrame) -> DataFrame:
    """swept with n_best and count_sum, by blocks of pairs that go to every task."""
    n = counts.count()
    blocks = max(1, -(-2 * n // LOOKUP)) if n > LOOKUP else 1
    block = F.pmod(F.xxhash64("pair"), F.lit(blocks))  # pairs are distinct, so a hash deals them evenly
    parts = []
    for k in range(blocks):
        at = counts.where(block == k).select("pair", "n", "best").toArrow().sort_by("pair")
        pairs, times, best = (at.column(c).to_numpy() for c in range(3))
        parts.append(_looked_up(swept if blocks == 1 else swept.select("row", "pairs", "links"), pairs.copy(), times.astype(np.int32) if n and times.max(initial=0) < 1 << 31 else times.copy(), best.copy(), last=blocks == 1))
    if blocks == 1:
        return parts[0]
    sums = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return swept.drop("pairs", "links").join(sums, "row")


def _looked_up(swept: DataFrame, pairs: np.ndarray, times: np.ndarray, best: np.ndarray, last: bool) -> DataFrame:
    @F.arrow_udf("struct<n_best: long, count_sum: long>")
    def look(packed: pa.Array, links: pa.Array) -> pa.Array:
        n_best, total = np.zeros(len(packed), np.int64), np.zeros(len(packed), np.int64)
        for i, (p, x) in enumerate(zip(packed.to_pylist(), links.to_pylist())):
            codes, many = np.cumsum(unpack(p)), unpack(x)
            if len(codes) and len(pairs):
                at = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
                known = pairs[at] == codes
                n_best[i] = (many * (best[at] & known)).sum()
                total[i] = (many * times[at] * known).sum()
        return pa.StructArray.from_arrays([pa.array(n_best), pa.array(total)], names=["n_best", "count_sum"])

    out = swept.withColumn("__found", look("pairs", "links"))
    rest = [c for c in swept.columns if c not in ("pairs", "links")] if last else ["row"]
    return out.select(*rest, "__found.n_best", "__found.count_sum")


def alignment_counts(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    sizes = _sizes(a_path, b_path)
    swept = materialize(sweep(token_events(df, a_path, b_path, id_col, text_col), sizes), "swept")
    out = with_counts(swept, pair_counts(swept, len(sizes[1])))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    """Contract query: alignment of a byte-level and a piece vocabulary on every document."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return alignment_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
