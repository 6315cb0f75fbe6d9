"""Byte-level BPE over a global shuffle of distinct words.

1. Each task explodes its documents into pre-tokens, in blocks of bounded size. A block keeps its documents
   as a sequence of codes, in which a code's places are the positions of one distinct word of the block.
2. The distinct words of all blocks are dealt out by their hash, so that equal words meet in one partition,
   where each is encoded once. A word occurs once for each block at most, however frequent it is, so no
   word is hot.
3. The ids go back to their blocks, where they replace the codes position by position.

Decoding looks the ids up in the table of token bytes. What moves is packed: words and ids once for each
block that has them, and codes at about 1.5 bytes for each pre-token.
"""

from __future__ import annotations

import base64
import gc
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.token_files import slices

#: Characters of text in a block, except that one document is never cut.
BLOCK_CHARS = 3_000_000
#: Words whose ids a task remembers while it encodes; beyond that it starts anew.
REMEMBERED = 300_000

PACKED = "key long, block long, kind int, blob binary"
CODES, WORDS, IDS = 0, 1, 2


def ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ids of a vocabulary of base64 and rank lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed blob; 32-bit integers as four planes of bytes."""
    out = []
    for a in arrays:
        raw = a if isinstance(a, bytes) else np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        out += [len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(blob: bytes) -> list[bytes]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def ints(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


#: Longest chunk, in bytes, that is compared by numpy.
SHORT = 64
_MASKS = np.array([*((1 << 8 * k) - 1 for k in range(8)), (1 << 64) - 1], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def told_apart(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The number of each chunk between single spaces among the distinct chunks, and these.

    Chunks are found by a hash of eight bytes at a time, and each is then compared with the one that it was taken for;
    if one differs, all are told apart by a dictionary instead.
    """
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1])
    sizes = np.diff(starts, append=len(raw) + 1) - 1
    eight = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    short, long = np.flatnonzero(sizes <= SHORT), np.flatnonzero(sizes > SHORT).tolist()
    chunk = lambda i: raw[starts[i] : starts[i] + sizes[i]]

    def part(of: np.ndarray, offset: int) -> np.ndarray:
        return eight[starts[of] + offset] & _MASKS[np.minimum(sizes[of] - offset, 8)]

    hashed = sizes.astype(np.uint64)
    for i in long:
        hashed[i] = hash(chunk(i)) & (1 << 64) - 1
    at = short
    for offset in range(0, SHORT, 8):
        x = (hashed[at] + part(at, offset)) * _ODD
        hashed[at] = x ^ (x >> np.uint64(29))
        at = at[sizes[at] > offset + 8]
    _, number = np.unique(hashed, return_inverse=True)
    one = np.empty(number.max() + 1, np.int64)
    one[number] = np.arange(len(number))
    taken = one[number]
    same = (sizes == sizes[taken]).all() and all(chunk(i) == chunk(taken[i]) for i in long)
    at = short[taken[short] != short]
    for offset in range(0, SHORT, 8):
        same = same and np.array_equal(part(at, offset), part(taken[at], offset))
        at = at[sizes[at] > offset + 8]
    if not same:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        return np.array([numbers[c] for c in raw.split(b" ")]), list(numbers)
    return number, [raw[a:b] for a, b in zip(starts[one].tolist(), (starts + sizes)[one].tolist(), strict=True)]


class Splitter:
    """Turns texts into codes of distinct pre-tokens; chunks between single spaces are split once for each block.

    A chunk that begins and ends with visible characters splits alike whatever stands beside it, so a block's distinct
    chunks are split together. A text's first chunk, which no space precedes, and texts with other white space beside a
    space or at their end are split whole; so are all texts, if the pattern lets no pre-token begin with the space.
    """

    #: A space beside white space, or at the end.
    odd = re.compile(r" (?:(?<=\s )|\s|\Z)").search

    def __init__(self, pattern: str) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        self.apart = True
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = defaultdict(count().__next__)

    def parts(self, texts: list[str]) -> tuple[list[str], list[int], np.ndarray, list[str], np.ndarray, np.ndarray]:
        """The words of what is split whole (one piece a text) and of the distinct chunks behind the pieces.

        Returns the former, where each text's end among them, each chunk's number, the latter, where each chunk's begin
        (and where they end), and how many chunks each text has behind its piece.
        """
        whole: list[str] = []
        ends, tails, behind = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            first, space, tail = text.partition(" ")
            if space and self.apart and not text[-1].isspace() and not self.odd(text):
                tails.append(tail)
                behind[i] = tail.count(" ") + 1
                whole += self.find(first)
            else:
                whole += self.find(text)
            ends.append(len(whole))
        if not tails:
            return whole, ends, np.zeros(0, np.int64), [], np.zeros(1, np.int64), behind
        number, chunks = told_apart(" ".join(tails).encode())
        words = self.find(f" {b' '.join(chunks).decode()}")
        starts = [i for i, w in enumerate(words) if w[0] == " "]
        if len(starts) != len(chunks):
            self.apart = False
            return self.parts(texts)
        return whole, ends, number, words, np.array([*starts, len(words)]), behind

    def distinct(self, texts: list[str]) -> set[str]:
        """The distinct pre-tokens of texts."""
        whole, _, _, words, _, _ = self.parts(texts)
        return {*whole, *words}

    def split_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of pre-tokens of each text, and the codes of all of them."""
        whole, ends, number, words, starts, behind = self.parts(texts)
        codes = np.fromiter(map(self.codes.__getitem__, whole + words), np.int64, len(whole) + len(words))
        first = np.cumsum(behind) - behind  # a text's piece comes before its first chunk
        n = np.insert(np.diff(starts)[number], first, np.diff(ends, prepend=0))
        begin = np.insert(starts[number] + len(whole), first, [0, *ends][:-1])
        stop = np.cumsum(n)
        lengths = np.diff(stop[np.cumsum(behind + 1) - 1], prepend=0)
        return lengths, codes[np.repeat(begin - (stop - n), n) + np.arange(n.sum())]

    def split(self, text: str) -> bytes:
        """The codes of the pre-tokens of a text, as 32-bit integers."""
        return self.split_all([text])[1].astype("<u4").tobytes()


def dealt(words: list[str], partitions: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words dealt out by their hash: those of the first partition, sorted, then those of the second, and so on.

    Returns the words as bytes, the place of each given word among them, and where the partitions end. It depends on
    nothing but the set of words, so two reads of a block number them alike.
    """
    encoded = [w.encode() for w in words]
    part = np.fromiter(map(zlib.crc32, encoded), np.int64, len(words)) % partitions
    begin = np.array(encoded, "S8").view(">u8").astype(np.uint64)
    order = np.lexsort((begin, part))
    alike = np.flatnonzero((np.diff(part[order]) == 0) & (np.diff(begin[order]) == 0))
    for run in np.split(alike, np.flatnonzero(np.diff(alike) > 1) + 1) if len(alike) else ():
        a, b = run[0], run[-1] + 2
        order[a:b] = sorted(order[a:b].tolist(), key=encoded.__getitem__)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return [encoded[i] for i in order.tolist()], place, np.cumsum(np.bincount(part, minlength=partitions))


def explode_words(pattern: str, partitions: int, kind: int):
    """For mapInArrow: documents (doc_id, text) to packed blocks; the rows of one kind are returned.

    The block's number is a hash of its documents, so both kinds agree however often a task is run. Words alone need no
    sequence, so for them a block's chunks are only told apart.
    """

    def block(splitter: Splitter, ids: list[int | None], texts: list[str], digest: int) -> list[tuple]:
        if kind == WORDS:
            words, _, ends = dealt(list(splitter.distinct(texts)), partitions)
            rows, a = [], 0
            for p, b in enumerate(ends.tolist()):
                if a < b:
                    sizes = np.fromiter(map(len, words[a:b]), np.int64, b - a)
                    rows.append((p, digest, WORDS, pack([a], sizes, b"".join(words[a:b]))))
                a = b
            return rows
        lengths, codes = splitter.split_all(texts)
        _, place, _ = dealt(list(splitter.codes), partitions)
        codes = place[codes]
        order = np.argsort(-np.bincount(codes, minlength=len(place)), kind="stable")  # frequent words get small codes
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        numbers = np.array([0 if x is None else x for x in ids], "<i8").tobytes()
        null = np.array([x is None for x in ids], np.uint8).tobytes()
        return [(digest, digest, CODES, pack(lengths, rank[codes], numbers, null, np.diff(order, prepend=0)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern)
        ids: list[int | None] = []
        docs: list[str] = []
        hashed, size = xxhash.xxh3_64(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, docs, hashed, size
            if rows := block(splitter, ids, docs, hashed.intdigest() - (1 << 63)):
                yield rows_of(rows)
            ids, docs, hashed, size = [], [], xxhash.xxh3_64(), 0
            splitter.clear()

        for batch in batches:
            for piece, texts in slices(batch, "text"):
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts, strict=True):
                    ids.append(doc_id)
                    docs.append(text)
                    hashed.update(f"{doc_id} {len(text)} ".encode())
                    hashed.update(text.encode())
                    size += len(text)
                if size >= BLOCK_CHARS:
                    yield from flush()
        if ids:
            yield from flush()

    return uncollected(run)


def uncollected(run):  # noqa: ANN001, ANN201
    """For functions of mapInArrow that make millions of small objects without cycles: no garbage collection meanwhile."""

    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return quiet


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    key, block, kind, blob = zip(*rows, strict=True)
    arrays = [pa.array(key, pa.int64()), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())]
    return pa.record_batch(arrays, names=["key", "block", "kind", "blob"])


@lru_cache(maxsize=1)
def encoding_of(vocabulary: str, pattern: str):  # noqa: ANN201
    """One encoding for all tasks of a worker."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks(vocabulary), special_tokens={})


def encode_words(vocabulary: str, pattern: str):
    """For mapInArrow over one partition of words: encode each distinct word once, and send the ids back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(vocabulary, pattern)
        piece = encoding._core_bpe.encode_single_piece  # the library splits a word again, which ASCII words don't need
        memo: dict[bytes, bytes] = {}
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob"), strict=True):
                first, sizes, joined = unpack(blob.as_py())
                ends = np.cumsum(ints(sizes)).tolist()
                words = [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                if len(memo) > REMEMBERED:
                    memo.clear()
                ids = list(map(memo.get, words))
                at = -1
                for _ in range(ids.count(None)):
                    at = ids.index(None, at + 1)
                    w = words[at]
                    ids[at] = memo[w] = array("I", piece(w) if w.isascii() else encoding.encode_ordinary(w.decode())).tobytes()
                n_ids = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield rows_of([(block, block, IDS, pack(ints(first), n_ids, np.frombuffer(b"".join(ids), "<u4")))])

    return uncollected(run)


def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the rows of a block, its ids before its codes, to documents with their ids."""
    current, parts = None, []
    for batch in batches:
        for block, kind, blob in zip(*(batch.column(c) for c in ("block", "kind", "blob")), strict=True):
            if block.as_py() != current:
                current, parts = block.as_py(), []
            if kind.as_py() == IDS:
                parts.append(blob.as_py())
                continue
            lengths, codes, numbers, null, steps = unpack(blob.as_py())
            lengths, codes, order = ints(lengths), ints(codes), np.cumsum(ints(steps).astype(np.int32))
            n_ids, where, pieces, base = np.full(len(order), -1, np.int64), np.zeros(len(order), np.int64), [], 0
            known = 0
            for part in parts:
                first, n, flat = map(ints, unpack(part))
                at = slice(int(first[0]), int(first[0]) + len(n))
                n_ids[at] = n
                where[at] = base + np.cumsum(n) - n
                pieces.append(flat)
                base += len(flat)
                known += len(n)
            n_ids, where = n_ids[order], where[order]
            if known != len(order) or (n_ids < 0).any():
                raise ValueError("a block lacks the ids of some of its words: its input changed between two reads")
            table = np.concatenate([*pieces, np.zeros(0, np.int64)]).astype(np.int32)
            doc_ids = np.frombuffer(numbers, "<i8")
            nulls = np.frombuffer(null, np.uint8).astype(bool)
            doc_ends = np.cumsum(lengths)
            step = max(1, int(len(lengths) * 2_000_000 / max(1, len(codes))))  # documents for about two million words
            for a in range(0, len(lengths), step):
                b = min(a + step, len(lengths))
                own = codes[doc_ends[a] - lengths[a] : doc_ends[b - 1]]
                n = n_ids[own]
                ends = np.cumsum(n)
                take = np.repeat(where[own] - (ends - n), n) + np.arange(int(n.sum()))
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths[a:b])])]
                yield pa.record_batch(
                    [
                        pa.array(doc_ids[a:b], mask=nulls[a:b]),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(table[take])),
                    ],
                    names=["doc_id", "ids"],
                )


def encode(docs: DataFrame, vocabulary: str, pattern: str, partitions: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) to (doc_id, ids), one row for each row, each match of pattern by itself.

    A null or empty text has no ids. Null ids, repeated ids and repeated rows keep their rows; an empty
    table gives none. docs is read twice (for the words, then for the codes) and must give each partition
    the same rows in the same order, as a scan does; else an error says so. Texts of any length are encoded whole;
    further columns are not read. A task encodes each of its words once, but for those that come again after
    REMEMBERED others.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = (
        rows.mapInArrow(explode_words(pattern, n, WORDS), PACKED)
        .repartitionById(n, F.col("key").cast("int"))  # the words' own numbers of their partitions
        .mapInArrow(encode_words(vocabulary, pattern), PACKED)
    )
    codes = rows.mapInArrow(explode_words(pattern, n, CODES), PACKED)
    return (
        ids.unionByName(codes)
        .repartitionById(n, F.pmod("key", F.lit(n)).cast("int"))
        .sortWithinPartitions("block", F.col("kind").desc())
        .mapInArrow(reassemble, "doc_id long, ids array<int>")
    )


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Add decoded (the bytes of the ids, joined) to rows with a column ids; an unknown id is an error.

    A column decoded that the rows have already is replaced, all others are passed on. A null list gives null.
    """
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: b for b, i in ranks(vocabulary).items()}
        token = [table.get(i) for i in range(max(table) + 1)]
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            values, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            joined = [b"".join([token[i] for i in values[a:b].tolist()]) for a, b in pairwise(bounds)]
            joined = [x if y.is_valid else None for x, y in zip(joined, lists, strict=True)] if lists.null_count else joined
            yield pa.record_batch([*batch.columns, pa.array(joined, pa.binary())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
