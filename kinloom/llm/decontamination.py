"""Benchmark decontamination with a positional inverted index.

The index holds the postings of every term of every training document, whatever the test set: a shard of it is a run
of documents, and for each document the index has its terms in order of their hashes, and each term's sorted
positions. It is written to the shared folder once and read for any number of test sets.

Test items are cut into windows of consecutive words. The index gives each test term's frequency over all documents.
A window is looked up from its rarest term: the positions of that term, less its offset in the window, are the
possible starts, and the lists of the other terms, adjusted by their offsets, are intersected with them from rare to
frequent until none is left.

The words of a test set are handled in blocks of bounded size, each against the whole index, so what each task is
sent doesn't grow with the test set, nor with the documents. Words are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import stored
from kinloom.llm.token_files import slices

#: Words of test items in a block (one item at least).
BLOCK_WORDS = 500_000
#: Lower-cases A-Z; keeps digits, letters and all bytes of non-ASCII characters; all else parts words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

INDEX = "key long, doc_id long, n_words long, terms binary, counts binary, positions binary"
MATCHES = "key long, doc_id long, n_words long, spans array<struct<start:int,stop:int>>, items array<long>, near array<long>"


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_WORD_BYTES).split()


def hashes_of(text: str) -> np.ndarray:
    """The words' hashes in the text's order."""
    found = words_of(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items (item_id, text) with their words' hashes, in blocks; those without id or words are left out."""
    block: list = []
    size = 0
    for row in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        if len(words := hashes_of(row.text)):
            block.append((row.item_id, words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def build_index(docs: DataFrame, key: str | None = None) -> DataFrame:
    """Postings of all terms of docs (doc_id, text), one row for each document; kept on disk.

    terms: distinct hashes, ascending (64 bits); counts: occurrences of each; positions: of each term in turn,
    ascending (32 bits). key names a column that tells rows apart; without it rows are numbered here, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch, "text"):
                rows = []
                for text in texts:
                    h = hashes_of(text)
                    order = np.argsort(h, kind="stable")
                    own = h[order]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
                    counts = np.diff(np.append(first, len(own)))
                    rows.append((len(h), own[first].tobytes(), counts.astype("<u4").tobytes(), order.astype("<u4").tobytes()))
                lists = [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]
                yield pa.record_batch(
                    [piece.column("key"), piece.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), *lists],
                    names=["key", "doc_id", "n_words", "terms", "counts", "positions"],
                )

    number = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    rows = docs.select(number.alias("key"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, INDEX), "postings")


def frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each of the vocabulary's hashes (ascending) occurs in all documents."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<u8")
            counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4")
            at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
            hit = wanted[at] == terms
            total += np.bincount(at[hit], counts[hit], len(wanted)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used])], names=["term", "n"])

    each = index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary), np.int64)
    for row in each.toLocalIterator():  # as many rows as the block has terms, at most
        out[row.term] = row.n
    return out


class Windows:
    """The distinct windows of a block in order of their rarest term; those with a term that never occurs are left out.

    All arrays: a window is a row of numbers in the vocabulary, filled up with -1, and a row of its offsets from
    the rarest term to the most frequent.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], vocabulary: np.ndarray, frequency: np.ndarray, width: int) -> None:
        rows, owner = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
        for item_id, hashes in items:
            terms = np.searchsorted(vocabulary, hashes).astype(np.int32)
            if len(terms) < width:
                terms = np.append(terms, np.full(width - len(terms), -1, np.int32))
            own = np.lib.stride_tricks.sliding_window_view(terms, width)
            rows.append(own)
            owner.append(np.full(len(own), item_id, np.int64))
        terms, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        often = np.where(terms >= 0, frequency[terms], np.iinfo(np.int64).max)
        order = np.argsort(often, axis=1, kind="stable").astype(np.int16)
        rarest = np.take_along_axis(terms, order[:, :1].astype(np.int64), 1)[:, 0] if len(terms) else np.zeros(0, np.int32)
        place = np.argsort(rarest, kind="stable")
        place = place[often[place].min(1) > 0] if len(place) else place
        self.vocabulary, self.terms, self.order, self.rarest = vocabulary, terms[place], order[place], rarest[place]
        self.length = (self.terms >= 0).sum(1)
        new = np.full(len(terms), -1)
        new[place] = np.arange(len(place))
        pairs = np.unique(np.stack([new[which.ravel()], np.concatenate(owner)]), axis=1)
        self.owners = pairs[1, pairs[0] >= 0]
        self.bounds = np.searchsorted(pairs[0, pairs[0] >= 0], np.arange(len(place) + 1))

    def search(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, at: np.ndarray, slop: int) -> tuple:
        """Starts and ends of the phrases that occur, the items they are of, and those near enough.

        at is scratch space: -1 for each term of the vocabulary.
        """
        spans, items, near = set(), set(), set()
        n = len(self.vocabulary)
        known = np.minimum(np.searchsorted(self.vocabulary, terms), max(n - 1, 0))
        own = np.flatnonzero(self.vocabulary[known] == terms) if n else np.zeros(0, np.int64)
        here = known[own]
        first, last = np.searchsorted(self.rarest, here), np.searchsorted(self.rarest, here, "right")
        some = last - first
        candidates = np.repeat(first - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))
        if len(candidates):
            at[here] = own
            rows = self.terms[candidates]
            candidates = candidates[((at[rows] >= 0) | (rows < 0)).all(1)]
            ends = np.cumsum(counts, dtype=np.int64)
            lists: dict[int, np.ndarray] = {}

            def of(term: int) -> np.ndarray:
                if term not in lists:
                    k = at[term]
                    lists[term] = positions[ends[k] - counts[k] : ends[k]].astype(np.int64)
                return lists[term]

            for w in candidates.tolist():
                length, row = int(self.length[w]), self.terms[w]
                starts = None
                for o in self.order[w, :length].tolist():
                    shifted = of(int(row[o])) - o
                    starts = shifted if starts is None else starts[np.isin(starts, shifted, assume_unique=True)]
                    if not len(starts):
                        break
                owners = self.owners[self.bounds[w] : self.bounds[w + 1]].tolist()
                if len(starts):
                    spans.update((s, s + length) for s in starts.tolist())
                    items.update(owners)
                elif slop and closest([of(t).tolist() for t in row[:length].tolist()]) <= length + slop:
                    near.update(owners)
            at[here] = -1
        return merged(spans), items, near - items


def closest(lists: list[list[int]]) -> float:
    """Length of the shortest stretch that holds a position of each list in their order, others between them."""
    best = float("inf")
    for start in lists[0]:
        at = start
        for own in lists[1:]:
            if (i := bisect_right(own, at)) == len(own):
                return best
            at = own[i]
        best = min(best, at - start + 1)
    return best


def merged(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of [start, stop) spans as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def search_index(index: DataFrame, windows: Windows, slop: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(windows)  # at most BLOCK_WORDS windows, about 60 bytes each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        at = np.full(len(windows.vocabulary), -1, np.int64)
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c) for c in ("terms", "counts", "positions")), strict=True):
                terms, counts, positions = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, ("<u8", "<u4", "<u4"), strict=True))
                found.append(windows.search(terms, counts, positions, at, slop))
            spans = pa.array(
                [[{"start": s, "stop": e} for s, e in x[0]] for x in found],
                pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])),
            )
            ids = [pa.array([sorted(x[i]) for x in found], pa.list_(pa.int64())) for i in (1, 2)]
            yield pa.record_batch(
                [batch.column("key"), batch.column("doc_id"), batch.column("n_words"), spans, *ids],
                names=["key", "doc_id", "n_words", "spans", "items", "near"],
            )

    return index.mapInArrow(run, MATCHES)


def find_items(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 0, key: str | None = None) -> DataFrame:
    """Where windows of items (item_id, text) occur in docs (doc_id, text).

    Returns one row for each row of docs: key (of the row), doc_id, n_words, spans (stretches of words inside
    any occurrence of a window, disjoint, in order), items (distinct ids, ascending, of the items with a window
    that occurs) and near (of those with a window whose words all occur in order with at most slop other words
    between them, and no exact one; empty if slop is 0).

    A window is width consecutive words; an item of fewer words is one window. Null and empty texts have no
    words. An item without id is left out; items with equal ids count as one; repeated documents each keep
    their row. Without items, every row has empty lists; without documents there are no rows. Texts of any length
    are indexed whole. key names a column of docs that tells its rows apart, if there is one; further columns
    are not read.
    """
    return search_items(build_index(docs, key), items, width, slop)


def search_items(index: DataFrame, items: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """find_items() over an index that build_index() returned."""
    found = None
    several = False
    for block in blocks(items):
        vocabulary = np.unique(np.concatenate([h for _, h in block]))
        own = search_index(index, Windows(block, vocabulary, frequencies(index, vocabulary), width), slop)
        several = found is not None
        found = found.unionByName(own) if several else own
    if found is None:
        none = np.zeros(0, np.uint64)
        return search_index(index, Windows([], none, np.zeros(0, np.int64), width), slop)
    return across_blocks(found) if several else found


def across_blocks(found: DataFrame) -> DataFrame:
    """One row for each document from its rows of each block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                spans = merged({(s["start"], s["stop"]) for s in r["spans"]})
                r |= {"spans": [{"start": s, "stop": e} for s, e in spans]}
                r |= {"items": sorted({*r["items"]}), "near": sorted({*r["near"]} - {*r["items"]})}
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")]
    return found.groupBy("key", "doc_id", "n_words").agg(*lists).mapInArrow(run, MATCHES)
