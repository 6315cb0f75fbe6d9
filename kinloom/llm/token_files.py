"""Token-id files: Parquet with one row for each document, in ascending document order.

Columns: doc_id, part (the file's place in the order), before (ids that stand before the document within
its part), n_tokens, ids (list of int). Dictionary pages and bit packing hold the ids; ``PARQUET_2_0`` pages
use delta encoding for the counts; row groups and pages have set sizes and page indexes, so a reader that
asks for counts, or for a range of documents, reads no other ids.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Size of a row group, of a page and of a dictionary page, in bytes.
FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.page.row.count.limit": "4000",
}
#: Characters of text in a slice, those whose chunks are told apart at once, and chunks that a worker remembers.
SLICE_CHARS, ENCODED_CHARS, REMEMBERED = 1_000_000, 3_000_000, 250_000
#: Slots of the table that tells a chunk's first sight from later ones.
SEEN = 1 << 22
#: Marks that often end a chunk: neither letters, digits nor white space, and no apostrophe.
MARKS = ".,;:!?)]}\"#$%&*+-/<=>@\\^_`|~"


def told_apart(text: str) -> tuple[np.ndarray, list[str]]:
    """The number of each chunk between single spaces among the distinct chunks, and these."""
    # Arrow's dictionary compares whole values; each chunk keeps the space behind it.
    raw = f"{text} ".encode()
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1
    bounds = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
    chunks = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
    distinct = chunks.dictionary
    _, bounds, joined = distinct.buffers()
    end = np.frombuffer(bounds, np.int64)[distinct.offset + len(distinct)]
    return chunks.indices.to_numpy(), joined[: int(end)].to_pybytes().decode().split(" ")[:-1]


class ChunkEncoder:
    """Encodes texts with the tokenizers library, remembering the ids of chunks between single spaces.

    A byte-level tokenizer starts a pre-token at a space that precedes a visible character. So the ids of
    `` chunk`` don't depend on its neighbours, if the chunk begins and ends with a visible character. A line break
    alone between visible characters is a pre-token, so a chunk ends there too, and the next begins with the break.
    Texts with any other chunk (runs of spaces, a line break beside a space) or with the text of an added token are
    encoded whole. Ids are kept as the bytes of 32-bit integers, from a chunk's second sight on (by a table of hashes; an equal hash only keeps a
    chunk earlier), in two generations of bounded size, so that frequent chunks stay.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None:
            raise ValueError("the tokenizer changes texts before it splits them, so chunks can't be encoded apart")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.seen = bytearray(SEEN)
        # The byte-level alphabet: visible bytes of Latin-1 stand for themselves, the others follow from 256 on.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.letters = {b: 256 + i for i, b in enumerate(hidden)}
        self.space = chr(self.letters[32])
        self.ends: dict[str, bytes] = {}
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, letters: str, space: str) -> bytes:
        """One pre-token of letters."""
        word = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        return array("i", [t.id for t in self.tokenize(space + word)]).tobytes()

    def apart(self, chunk: str, space: str) -> bytes:
        """The ids of a chunk that begins and ends with visible characters, behind a space or none."""
        core = chunk.rstrip(MARKS)
        if not core.isalpha():
            return self.whole(f" {chunk}" if space else chunk)
        marks = chunk[len(core) :]  # letters are a pre-token, and so are the marks behind them
        if (end := self.ends.get(marks)) is None:
            end = self.whole(marks)
            if len(self.ends) < REMEMBERED:
                self.ends[marks] = end
        if space and (ids := self.young.get(core) or self.old.get(core)):
            return ids + end
        return self.word(core, space) + end

    def remember(self, chunk: str) -> bytes | None:
        """The ids of a chunk that the young generation lacks, or None if it can't be encoded apart."""
        if (ids := self.old.get(chunk)) is None:
            if chunk.isalpha():
                ids = self.word(chunk, self.space)
            elif not chunk or chunk[-1].isspace():
                return None
            elif chunk[0] == "\n":
                if chunk[1].isspace():
                    return None
                ids = self.newline + self.apart(chunk[1:], "")
            elif chunk[0].isspace():
                return None
            else:
                ids = self.apart(chunk, self.space)
            slot = hash(chunk) % SEEN
            if not self.seen[slot]:
                self.seen[slot] = 1
                return ids
        if len(self.young) >= REMEMBERED:
            self.old, self.young, self.seen = self.young, {}, bytearray(SEEN)
        self.young[chunk] = ids
        return ids

    def encode_all(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, with end behind each, and all their ids.

        The distinct chunks of all texts are looked up, or encoded, once; a text with a chunk that can't be encoded
        apart is encoded whole.
        """
        heads: list[bytes] = []
        tails, behind = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            first, space, tail = text.replace("\n", " \n").partition(" ")
            if not space or first[-1:].isspace() or any(x in text for x in self.added):
                heads.append(self.whole(text))
                continue
            heads.append(self.whole(first) if first[:1].isspace() else self.apart(first, "") if first else b"")
            tails.append(tail)
            behind[i] = tail.count(" ") + 1
        first = np.cumsum(behind) - behind  # a text's head comes before its first chunk
        number, ids, lost = np.zeros(0, np.int64), [], []
        if tails:
            number, chunks = told_apart(" ".join(tails))
            ids = list(map(self.young.get, chunks))
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                if (made := self.remember(chunks[at])) is None:
                    lost.append(at)
                ids[at] = made or b""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = sizes[number]
        if lost:
            held = np.isin(number, lost)
            owner = np.repeat(np.arange(len(texts)), behind)
            for i in np.unique(owner[held]).tolist():
                heads[i] = self.whole(texts[i])
                n[first[i] : first[i] + behind[i]] = 0
        head_sizes = np.fromiter(map(len, heads), np.int64, len(heads)) // 4
        flat = np.frombuffer(b"".join([*ids, *heads, end]), "<i4")
        before = np.cumsum(sizes) - sizes
        before_heads = int(sizes.sum()) + np.cumsum(head_sizes) - head_sizes
        # For each text its head, its chunks and the end.
        where = np.stack([first, first + behind], axis=1).ravel()
        n = np.insert(n, where, np.stack([head_sizes, np.full(len(texts), len(end) // 4)], axis=1).ravel())
        begin = np.insert(before[number], where, np.stack([before_heads, np.full(len(texts), len(flat) - len(end) // 4)], axis=1).ravel())
        stop = np.cumsum(n)
        counts = np.diff(stop[np.cumsum(behind + 2) - 1], prepend=0)
        return counts, flat[np.repeat(begin - (stop - n), n) + np.arange(n.sum())]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[1].tobytes()


@lru_cache(maxsize=1)
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker, so that they share what it remembers."""
    return ChunkEncoder(path)


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def slices(batch: pa.RecordBatch, text: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch so that each piece holds a bounded amount of text (one document at least)."""
    column = batch.column(text)
    texts: list[str] = []
    start = size = 0
    for i, t in enumerate(column):
        texts.append(t.as_py())
        size += len(texts[-1] or "")
        if size >= chars or i + 1 == len(column):
            yield batch.slice(start, i + 1 - start), texts
            start, size, texts = i + 1, 0, []


def encode_rows(tokenizer: str, end_id: int):
    """The function for mapInArrow: (doc_id, text) to the columns of the files; rows come in file order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), packed([end_id])
        part, before = TaskContext.get().partitionId(), 0
        gc.disable()  # the tokens that the library returns, millions of short-lived objects, hold no cycles
        try:
            for batch in batches:
                for piece, texts in slices(batch, "text", ENCODED_CHARS):
                    n, flat = encoder.encode_all(texts, end)
                    ends = np.cumsum(n)
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    yield pa.record_batch(
                        [
                            piece.column("doc_id"),
                            pa.array(np.full(len(n), part, np.int32)),
                            pa.array(before + ends - n),
                            pa.array(n),
                            pa.ListArray.from_arrays(offsets, pa.array(flat)),
                        ],
                        names=["doc_id", "part", "before", "n_tokens", "ids"],
                    )
                    before += int(ends[-1])
        finally:
            gc.enable()

    return run


SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Encode docs (doc_id, text) and write the files, sorted by doc_id, with end_id after each document.

    A null text is empty: its row holds end_id alone. Rows with a null id come first. Rows with equal ids
    (or null ids) are all kept, ordered by a hash of their text; the same hash spreads them over the parts.
    An empty table gives files without rows.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    (
        docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(encode_rows(tokenizer, end_id), SCHEMA)
        .write.options(**FORMAT)
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Read the files: doc_id, start (ids of all documents before it), n_tokens and, if asked for, ids.

    The places of the parts come from the counts alone, one number for each part.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = (
        rows.groupBy("part")
        .agg(F.sum("n_tokens").alias("in_part"))
        .select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("base"))
    )
    return rows.join(F.broadcast(parts), "part").select(  # two numbers for each part of the files
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", *["ids"] * ids
    )


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: replace ids by the CRC-32 of their little-endian unsigned 32-bit integers."""
    for batch in batches:
        lists = batch.column("ids")
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
        bounds = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )
