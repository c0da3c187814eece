"""SentencePiece encoding and decoding by a distinct-chunk table.

The vocabulary is checked first: no piece may hold a space marker after another
character. Then no merge crosses from the end of a word into the next marker,
so a text's segmentation is that of its marked words (a run of markers with
what follows up to the next marker) in a row. Each task keeps a table of the
distinct marked words it meets, has the library segment each of them once, and
joins ids back to the texts by position. Nothing is shuffled. The table is
emptied when it holds TABLE_WORDS words, which only costs segmenting again.

If the vocabulary fails the check, whole texts go to the library.

Defined cases: a null or empty text has no ids and decodes to the empty text;
output columns replace input columns of the same name; other columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import bounded_batches, documents

MARK = "▁"
TABLE_WORDS = 100_000
#: Words segmented by one call of the library.
CALL_WORDS = 20_000
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")

RESULT = "struct<ids: array<int>, decoded: string>"


def pieces_respect_markers(processor) -> bool:
    """Whether no piece of the vocabulary has a marker after another character."""
    return not any(MARK in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.get_piece_size()))


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker; '' has none."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [m[1:] for m in CHUNK.findall(MARK + text.replace(" ", MARK))]


class ChunkTable(dict):
    """Marked word -> row of the table; new words wait in `pending` until `segment`."""

    def __init__(self, processor):
        super().__init__()
        self.processor, self.pending = processor, []
        self.ids, self.start, self.size, self.text = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def __missing__(self, word: str) -> int:
        self.pending.append(word)
        self[word] = row = len(self)
        return row

    def segment(self) -> None:
        if not self.pending:
            return
        flat, sizes = [self.ids], [self.size]
        for at in range(0, len(self.pending), CALL_WORDS):
            words = self.pending[at : at + CALL_WORDS]
            found = self.processor.encode(words, num_threads=1)
            self.text += self.processor.decode(found, num_threads=1)
            if "" in words:  # a marker at a text's end; given alone, the library would drop it
                found[words.index("")] = [self.processor.piece_to_id(MARK)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter((i for ids in found for i in ids), np.int32, int(sizes[-1].sum())))
        self.pending = []
        self.ids, self.size = np.concatenate(flat), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size


def encode_rows(table: ChunkTable, texts: list[str | None]) -> pa.Array:
    """Ids and decoded text of each of a few texts."""
    rows = [np.fromiter(map(table.__getitem__, marked_words(t or "")), np.int64, -1) for t in texts]
    table.segment()
    ends, values = [0], []
    decoded = []
    for chunks in rows:
        size = table.size[chunks]
        total = int(size.sum())
        first = np.cumsum(size) - size
        values.append(table.ids[np.repeat(table.start[chunks] - first, size) + np.arange(total)])
        ends.append(ends[-1] + total)
        decoded.append(" ".join([table.text[c] for c in chunks.tolist()]))
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int32()))
    return pa.StructArray.from_arrays([ids, pa.array(decoded, pa.string())], names=["ids", "decoded"])


def encode_whole(processor, texts: list[str | None]) -> pa.Array:
    ids = processor.encode([t or "" for t in texts], num_threads=1)
    return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(processor.decode(ids, num_threads=1), pa.string())], names=["ids", "decoded"])


def _slices(texts: pa.Array, chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """A batch in runs of rows of about so many characters; a longer text is a run of its own."""
    part, held = [], 0
    for t in texts.to_pylist():
        part.append(t)
        held += len(t or "")
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def sentencepiece_round_trip(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the ids of each text and the text that the ids decode to.

    model_path is read on the driver and sent with the tasks, so executors need no file.
    """
    model = Path(model_path).read_bytes()
    bounded_batches(df.sparkSession)

    @F.arrow_udf(RESULT)
    def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        whole = not pieces_respect_markers(processor)
        table = ChunkTable(processor)
        for texts in batches:
            parts = []
            for part in _slices(texts):
                if whole:
                    parts.append(encode_whole(processor, part))
                    continue
                parts.append(encode_rows(table, part))
                if len(table) > TABLE_WORDS:
                    table = ChunkTable(processor)
            yield pa.concat_arrays(parts)

    both = "__ketframe_sp"
    out = df.withColumn(both, round_trip(F.col(text_col)))
    return out.withColumns({ids_col: F.col(both)["ids"], decoded_col: F.col(both)["decoded"]}).drop(both)


def op9(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of ids and decoded text of every document."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = sentencepiece_round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
