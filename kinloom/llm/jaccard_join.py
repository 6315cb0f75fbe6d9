"""Near duplicates: an exact Jaccard join of word-shingle sets, by size-banded tiles with bitmap signatures.

A text's set is its distinct shingles. Texts with the same set form one node, so copies are never compared.

1. All nodes are hashed: size, a bitmap signature (a shingle sets the bit of its hash; a large set has more bits,
   and two signatures are compared at the smaller size), and a sketch of how often shingles occur in all
   documents. Shingles are ordered from rare to frequent by the sketch, then by hash. Two sets that are similar
   enough share one of their first ``size / 5 + 1`` shingles in this order.
2. Nodes that share such a shingle form a group. In rounds, each is compared with the leaders of about LEADERS
   of its groups: a leader is the node with the smallest hash of shingle, node and round, so every group has one of
   its own. The links join groups of near copies into components, at a cost linear in their size. Each round
   has other leaders, in groups that still hold several components; the rounds end when one finds few links.
3. What is left is cut into tiles of at most two blocks of TILE nodes: a small group is one; a large one is cut by
   size into bands, and these by hash into blocks, and two blocks are a tile if their bands' sizes can match. Within
   a tile, bit counts bound the overlap of all pairs from above; those of different components that may be
   similar enough become candidates. A large group is many tiles of equal cost, none a task of its own.
4. Candidates are decided by intersecting the sorted arrays of hashes. Components come from the links.

Hashes of shingles and of sets have 64 bits; nothing else is approximate. Tables that a later one replaces are
deleted from the shared folder as soon as that is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import discard, stored
from kinloom.llm.token_files import slices

#: Leaders that a node is compared with, about.
LEADERS = 20
#: Bits of a signature, for each shingle and the least and most in all; counters of the sketch; nodes in a block of
#: a tile; bits of the filter of wanted sets, at most (a fuller filter lets more sets through, none is lost).
SPREAD, LEAST_BITS, MOST_BITS, CELLS, TILE, FILTER_BITS = 4, 2048, 65536, 1 << 20, 500, 1 << 28
#: A round of leaders is followed by another if it found so many links for each row in open groups.
WORTH = 0.05
#: Bytes of prefix shingles that are dealt to a partition, about.
PARTITION = 64 << 20
#: Copies that a shingle's group is dealt into for each doubling of its sketched frequency over the threshold.
SPLIT = 4
#: Odd multipliers that tell the places of a shingle's words apart; the finishing multipliers of the hash.
PLACES = [(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 for k in range(1, 65)]
FINISH = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BLOCK = 4096

NODES = "key long, doc_id long, n int, id long, bits binary, cells binary"


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of width words; of all words if they are fewer; none without words.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += words[k : k + n] * np.uint64(PLACES[k])
    for m in FINISH:
        h ^= h >> np.uint64(33)
        h *= m
    return np.unique(h ^ (h >> np.uint64(33)))


def set_id(h: np.ndarray) -> int:
    """The node of a set, as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def signature(h: np.ndarray) -> bytes:
    size = LEAST_BITS
    while size < min(SPREAD * len(h), MOST_BITS):
        size *= 2
    bits = np.zeros(size, bool)
    bits[h & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) as the shorter ones of the same sets."""
    return np.bitwise_or.reduce(words.reshape(len(words), -1, width), axis=1)


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)) & np.uint64(CELLS - 1)


def prefix(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first size / 5 + 1 shingles, from rare to frequent; any partner at 0.8 or more shares one."""
    return h[np.lexsort((h, levels[cell(h)]))[: len(h) // 5 + 1]]


def make_nodes(rows: DataFrame, width: int) -> DataFrame:
    """Each document's node, and the sketch's counters as rows without key; kept on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(CELLS, np.int32)
        names, types = ["key", "doc_id", "n", "id", "bits", "cells"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for piece, texts in slices(batch, "text"):
                out = []
                for key, doc_id, text in zip(*(piece.column(c).to_pylist() for c in ("key", "doc_id")), texts, strict=True):
                    h = shingles(text, width)
                    np.add.at(counters, cell(h), 1)
                    out.append((key, doc_id, len(h), set_id(h), signature(h), None))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        parts = [(None, None, i, None, None, c.tobytes()) for i, c in enumerate(counters.reshape(-1, BLOCK)) if c.any()]
        if parts:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], names=names)

    return stored(rows.mapInArrow(run, NODES), "jaccard-nodes")


def frequency_levels(nodes: DataFrame) -> np.ndarray:
    """For each counter of the sketch, 0 or how many times it doubles twice the mean. CELLS bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column("n").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                own = np.frombuffer(blob, np.int32).astype(np.int64)
                total[i] = total[i] + own if i in total else own
        yield pa.record_batch([pa.array(total, pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["n", "cells"])

    parts = nodes.where("key IS NULL").select("n", "cells").repartition(8, "n").mapInArrow(run, "n int, cells binary")
    counters = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for row in parts.toLocalIterator():
        counters[row.n] = np.frombuffer(row.cells, np.int64)
    counters = counters.ravel()
    return np.maximum(0, np.floor(np.log2(np.maximum(counters, 1) / (2 * counters.mean() + 16))) + 1).astype(np.uint8)


def shared_prefixes(rows: DataFrame, width: int, levels: np.ndarray, tokens_in_all: int) -> DataFrame:
    """(token, id, n): nodes by each prefix shingle that another node of a size that can match has too; kept on disk.

    The nodes of a shingle that the sketch takes for frequent are dealt to SPLIT tasks for each of its levels, by
    their id, so a hot shingle is no task of its own; there, a single node may stay, which closes its group later.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(levels)  # CELLS bytes

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for _, texts in slices(batch, "text"):
                tokens, ids, sizes = [np.zeros(0, np.int64)], [], []
                for text in texts:
                    h = shingles(text, width)
                    if len(h) and (own := set_id(h)) not in met:
                        if len(met) > 1_000_000:
                            met.clear()
                        met.add(own)
                        tokens.append(prefix(h, sent.value).view(np.int64))
                        ids.append(own)
                        sizes.append(len(h))
                repeat = [len(t) for t in tokens[1:]]
                flat = np.concatenate(tokens)
                owner, n = (np.repeat(np.array(x, t), repeat) for x, t in ((ids, np.int64), (sizes, np.int32)))
                parts = SPLIT * sent.value[cell(flat.view(np.uint64))].astype(np.int64)
                part = np.where(parts > 0, 1 + owner % np.maximum(parts, 1), 0).astype(np.int32)
                yield pa.record_batch([pa.array(x) for x in (flat, part, owner, n)], names=["token", "part", "id", "n"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "part", "n", "id"]
        held, held_met = np.zeros((4, 0), np.int64), False  # the last row, until the next one is known
        for batch in chain(batches, [None]):
            x = held
            if batch is not None:
                new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
                x = np.concatenate([held, np.stack(new)], axis=1)
                x = x[:, np.append(True, (x[:, 1:] != x[:, :-1]).any(0))[: x.shape[1]]]
            if not x.shape[1]:
                continue
            # Rows come by size, so a row that can match any has a neighbour that it can match.
            meets = (x[:2, 1:] == x[:2, :-1]).all(0) & (5 * x[2, :-1] >= 4 * x[2, 1:])
            before = np.append(held_met, meets)
            chosen = before | np.append(meets, False) | (x[1] > 0)
            if batch is not None:
                chosen[-1] = False
            if chosen.any():
                yield pa.record_batch([pa.array(x[0, chosen]), pa.array(x[3, chosen]), pa.array(x[2, chosen].astype(np.int32))], names=["token", "id", "n"])
            held, held_met = x[:, -1:], bool(before[-1])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens_in_all * 24 // PARTITION)
    sorted_rows = (
        rows.select("text")
        .mapInArrow(emit, "token long, part int, id long, n int")
        .repartition(parts, "token", "part")
        .sortWithinPartitions("token", "part", "n", "id")
    )
    return stored(sorted_rows.mapInArrow(shared, "token long, id long, n int"), "jaccard-shared")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs (a, an, b, bn) that sizes and bit counts allow to be similar enough."""
    bits = nodes.where("n > 0").groupBy("id").agg(F.min("bits").alias("bits"))
    small = pairs.where("5 * least(an, bn) >= 4 * greatest(an, bn)").distinct()
    both = (
        small.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("a_bits")), "a")
        .join(bits.select(F.col("id").alias("b"), F.col("bits").alias("b_bits")), "b")
        .select("a", "an", "b", "bn", "a_bits", "b_bits")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("an", "bn")), batch.column("a_bits"), batch.column("b_bits"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), "<u8")[None] for v in (x, y))
                width = min(p.shape[1], q.shape[1])
                kept.append(bool(may_match(np.int64(n), np.int64(m), folded(p, width), folded(q, width))[0]))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def by_width(column: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The width of each signature in words; for each width, the rows that have it and their signatures."""
    blobs = column.to_pylist()
    widths = np.array([len(b) // 8 for b in blobs])
    rows = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
    return widths, {w: (at, np.frombuffer(b"".join(blobs[i] for i in at), "<u8").reshape(len(at), w)) for w, at in rows.items()}


def may_match(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with the signatures p and q (rows of words, of one width) can reach 0.8.

    Each bit that is set in one signature alone stands for a shingle of that set alone, which bounds the overlap.
    """
    only_p, only_q = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (p & ~q, q & ~p))
    return 9 * np.minimum(n - only_p, m - only_q) >= 4 * (n + m)


def links(pairs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, decided on the sets themselves; kept on disk.

    The sets are made again from the texts, for the wanted nodes only: a Bloom filter of at most FILTER_BITS
    bits holds them. Where more are wanted, more sets than needed move, with the same result.
    """
    spark = rows.sparkSession
    pairs = stored(pairs, "jaccard-pairs")
    wanted = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "jaccard-wanted")
    bits = 1 << 16
    while bits < min(FILTER_BITS, 10 * wanted.count()):
        bits *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            for at in places(batch.column("id").to_numpy(zero_copy_only=False), bits):
                own[at] = True
        yield pa.record_batch([pa.array([np.packbits(own).tobytes()], pa.binary())], names=["bits"])

    held = np.zeros(bits // 8, np.uint8)
    for row in wanted.coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        held |= np.frombuffer(row.bits, np.uint8)
    sent = spark.sparkContext.broadcast(held)  # FILTER_BITS / 8 bytes at most

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, met = np.unpackbits(sent.value).astype(bool), set()
        for batch in batches:
            for _, texts in slices(batch, "text"):
                out = []
                for text in texts:
                    h = shingles(text, width)
                    i = set_id(h)
                    if len(h) and i not in met and all(own[at] for at in places(np.array([i]), bits)):
                        if len(met) > 1_000_000:
                            met.clear()
                        met.add(i)
                        out.append((i, h.tobytes()))
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["id", "set"])

    sets = stored(
        rows.select("text").mapInArrow(make, "id long, set binary").join(wanted, "id", "left_semi").dropDuplicates(["id"]), "jaccard-sets"
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                kept.append(100 * both >= 80 * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("a_set")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("b_set")), "b"
    )
    found = stored(joined.select("a", "b", "a_set", "b_set").mapInArrow(decide, "a long, b long"), "jaccard-links")
    discard(pairs, wanted, sets)
    return found


def places(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three places of each id in a filter of so many bits (a power of two)."""
    h = ids.astype(np.int64).view(np.uint64)
    for m in (*FINISH, np.uint64(0x9E3779B97F4A7C15)):
        x = (h ^ (h >> np.uint64(31))) * m
        yield ((x >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches; kept on disk.

    Each round gives a node the smallest label beside it, and then its label's label; the labels are written
    down after each, so a lost executor costs one round at most.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "jaccard-labels")
    while True:
        beside = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = stored(
            labels.select("id", "component").join(beside, "id")
            .join(jump, "component")
            .select("id", F.least("least", "further").alias("component"), (F.least("least", "further") < F.col("component")).alias("moved")),
            "jaccard-labels",
        )
        done = after.where("moved").isEmpty()
        discard(labels)
        labels = after
        if done:
            discard(both)
            return labels


def open_groups(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(token, id, n, component): the rows of groups (token, id, n) with several components; kept on disk.

    Of groups with the same members one is kept.
    """
    placed = groups.select("token", "id", "n")
    if labels is None:
        placed = placed.withColumn("component", F.col("id"))
    else:
        placed = placed.join(labels.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    members_of = [F.count("*"), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit("second")))]
    sizes = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), *[m.alias(f"m{i}") for i, m in enumerate(members_of)])
    mixed = sizes.where("x < y").groupBy("m0", "m1", "m2").agg(F.min("token").alias("token")).select("token")
    return stored(placed.join(mixed, "token", "left_semi"), "jaccard-open")


def led(groups: DataFrame, turn: int) -> DataFrame:
    """(a, an, b, bn): nodes b of groups (token, id, n, component) with the leaders a of about LEADERS of their groups.

    A group's leader is its node with the smallest hash of token, turn and id. It is found by an aggregate that each
    task begins by itself, so a large group is no task of its own.
    """
    first = F.min(F.struct(F.xxhash64("token", "id", F.lit(turn)).alias("h"), "id", "n", "component"))
    leaders = groups.groupBy("token").agg(first.alias("x")).select("token", F.col("x.id").alias("a"), F.col("x.n").alias("an"), F.col("x.component").alias("ac"))
    # Of a node's n / 5 + 1 groups, those whose hash is low enough; nodes of about one size take about the same groups.
    few = F.pmod(F.xxhash64("token", F.lit(turn)), F.lit(1 << 20)) * F.col("n") < 5 * LEADERS << 20
    return (
        groups.where(few)
        .join(leaders, "token")
        .where(F.col("component") != F.col("ac"))
        .select("a", "an", F.col("id").alias("b"), F.col("n").alias("bn"))
    )


def tiles(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within groups (token, id, n, component) that signatures can't rule out."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25))).cast("int")  # sizes that match lie in one band or two neighbours
    rows = groups.withColumn("band", band)
    counts = rows.groupBy("token", "band").agg(F.count("*").alias("c"))
    whole = counts.groupBy("token").agg(F.sum("c").alias("all"))
    own = counts.join(whole.where(F.col("all") > TILE), "token").select("token", "band", F.ceil(F.col("c") / TILE).cast("int").alias("blocks"))
    beside = own.select("token", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above")).unionByName(
        own.select("token", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below")), allowMissingColumns=True
    )
    beside = beside.groupBy("token", "band").agg(F.max("above").alias("above"), F.max("below").alias("below"))
    cut = own.join(beside, ["token", "band"], "left").na.fill(0, ["above", "below"])
    placed = rows.join(cut, ["token", "band"], "left").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.coalesce("blocks", F.lit(1))).cast("int"))
    b, k = F.col("band"), F.col("block")

    def upto(n: str):  # noqa: ANN202
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def tile(x, i, y, j):  # noqa: ANN001, ANN202
        return F.struct(x.alias("band_1"), i.alias("block_1"), y.alias("band_2"), j.alias("block_2"))

    many = F.concat(
        F.transform(upto("blocks"), lambda j: tile(b, F.least(k, j), b, F.greatest(k, j))),
        F.transform(upto("above"), lambda j: tile(b, k, b + 1, j)),
        F.transform(upto("below"), lambda j: tile(b - 1, j, b, k)),
    )
    zero = F.lit(0)
    one = F.array(tile(zero, zero, zero, zero))
    dealt = placed.withColumn("tile", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(many)))
    first = F.col("blocks").isNull() | ((F.col("tile.band_1") == b) & (F.col("tile.block_1") == k))
    second = F.col("blocks").isNull() | ((F.col("tile.band_2") == b) & (F.col("tile.block_2") == k))
    bits = nodes.where("n > 0").groupBy("id").agg(F.min("bits").alias("bits"))
    keys = ["token", "tile"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            ids, sizes, part = (table[c].to_numpy().astype(np.int64) for c in ("id", "n", "component"))
            side_1, side_2 = (table[c].to_numpy(zero_copy_only=False) for c in ("first", "second"))
            if part.min() == part.max() or not (side_1.any() and side_2.any()):
                continue
            widths, x = by_width(table["bits"])
            row = np.concatenate([np.arange(len(at)) for at, _ in x.values()])[np.argsort(np.concatenate([at for at, _ in x.values()]))]
            found: set[tuple[int, int]] = set()
            for i in np.flatnonzero(side_1):
                # Within one block, each pair once.
                j = np.flatnonzero(side_2 & (part != part[i]) & (~(side_1 & side_2[i]) | (ids > ids[i])))
                j = j[5 * np.minimum(sizes[i], sizes[j]) >= 4 * np.maximum(sizes[i], sizes[j])]
                for w, (_, bits_of) in x.items() if len(j) else ():
                    k = j[widths[j] == w]
                    if len(k):
                        width = min(w, int(widths[i]))
                        own = folded(x[int(widths[i])][1][row[i]][None], width)
                        k = k[may_match(sizes[i], sizes[k], own, folded(bits_of[row[k]], width))]
                        found.update((int(min(ids[i], m)), int(max(ids[i], m))) for m in ids[k])
            if found:
                a, b = zip(*found, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    spread_out = (
        dealt.select("token", "tile", "id", "n", "component", first.alias("first"), second.alias("second"))
        .join(bits, "id")
        .select(*keys, "id", "n", "component", "first", "second", "bits")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .select("token", F.xxhash64("tile").alias("tile"), "id", "n", "component", "first", "second", "bits")
    )
    return spread_out.mapInArrow(compare, "a long, b long").distinct()


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile together; a tile has two blocks of about TILE rows at most."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        token, tile = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "tile"))
        new = np.flatnonzero((token[1:] != token[:-1]) | (tile[1:] != tile[:-1])) + 1
        bounds = [0, *new.tolist(), len(token)]
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            if start == stop:
                continue
            key = (int(token[start]), int(tile[start]))
            if key != last and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def join_components(docs: DataFrame, width: int = 5, key: str | None = None) -> DataFrame:
    """Group docs (doc_id, text) by links between sets with a Jaccard similarity of 0.8 or more.

    Returns one row for each row of docs: key (of the row), doc_id, n_shingles and component_id, the smallest
    doc_id that the row reaches by links, its own included. Texts with fewer than width words are one shingle
    of all their words; null and empty texts have no set, no links, and their own id. Rows with equal sets are
    linked, repeated rows too. A row without id takes part but gives no component its id; a component of such
    rows only has none. An empty table gives no rows. Texts of any length are compared whole. key names a column of
    docs that tells its rows apart, if there is one; further columns are not read.
    """
    placed = placed_rows(docs, width, key)
    least = placed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (
        placed.withColumn("join_key", spread())
        .join(least.withColumnRenamed("component", "join_key"), "join_key", "left")
        .select("key", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def linked_rows(docs: DataFrame, width: int = 5, key: str | None = None) -> DataFrame:
    """key, doc_id and group of each row of docs: linked rows have equal groups, whatever their ids; a row without a set is alone."""
    alone = F.col("n") == 0
    return placed_rows(docs, width, key).select("key", "doc_id", F.struct(alone.alias("alone"), F.when(alone, F.col("key")).otherwise(F.col("component")).alias("of")).alias("group"))


def spread() -> Column:
    """Rows without a set get keys of their own, so that they don't meet in one partition."""
    return F.coalesce("component", F.xxhash64("key"))


def placed_rows(docs: DataFrame, width: int, key: str | None = None) -> DataFrame:
    """key, doc_id, n (shingles), id (of the set) and component of each row of docs; component is null without a set.

    key names a column of docs that tells its rows apart, as common.keyed() makes; without it rows are numbered here.
    """
    number = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    rows = docs.select(number.alias("key"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = make_nodes(rows, width)
    own = nodes.where("key IS NOT NULL")
    tokens = own.agg(F.sum(F.floor(F.col("n") / 5) + 1)).first()[0] or 0
    shared = shared_prefixes(rows, width, frequency_levels(nodes), tokens)
    groups, labels, found, turn, worth = open_groups(shared, None), None, None, 0, True
    discard(shared)
    while worth and (left := groups.count()):
        new = links(possible(led(groups, turn), own), rows, width)
        worth = new.count() >= WORTH * left
        found, old = (new, None) if found is None else (stored(found.unionByName(new), "jaccard-links"), (found, new))
        if old:
            discard(*old)
        if labels is not None:
            discard(labels)
        labels, turn = components(found), turn + 1
        before, groups = groups, open_groups(groups, labels)
        discard(before)
    across = stored(tiles(groups, own), "jaccard-across")
    discard(groups)
    if not across.isEmpty():
        more = links(across, rows, width)
        labels = components(found.unionByName(more))
        discard(more)
    discard(across)
    if labels is None:
        return own.select("key", "doc_id", "n", "id").withColumn("component", F.when(F.col("n") > 0, F.col("id")))
    return own.select("key", "doc_id", "n", "id").join(labels.select("id", "component"), "id", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "id")))
