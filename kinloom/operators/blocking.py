"""Candidate generation: inverted indexes, exact keys, rare witnesses, rank fusion, vector search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators import compete
from kinloom.sources.files import stored


def postings(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token, tf) of each row."""
    return df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def weighted(post: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, token, w): (1 + ln tf) * idf, of length 1 for each key. idf: (token, idf)."""
    w = post.join(idf, "token").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, key).select(key, "token", (F.col("w") / F.col("norm")).alias("w"))


def smoothed_idf(post: DataFrame, key: str, least: int = 1, most: int | None = None) -> DataFrame:
    """(token, df, idf) with idf = ln((n + 1) / (df + 1)) + 1 over n keys; tokens outside least..most are left out.

    The bounds belong to the operator: a token in more than most rows makes no candidates.
    """
    n = post.select(F.countDistinct(key)).first()[0]
    df = post.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return (df if most is None else df.where(F.col("df") <= most)).withColumn("idf", F.ln(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1)


def share_cap(n: int, least: int = 1) -> int:
    """References that may share a token which makes candidates: 3 % of all n, 2,000 at most."""
    return max(least, min(2000, n * 3 // 100))


def cosine_all_tokens(targets: DataFrame, refs: DataFrame, makers: DataFrame) -> DataFrame:
    """(tid, qid, score): cosine over all tokens (tid|qid, token, w) of the pairs that share a token of makers (token).

    Common tokens meet the pairs only, never each other's whole lists.
    """
    near = targets.select("tid", "token").join(refs.join(makers.select("token"), "token").select("qid", "token"), "token")
    return cosine_of_pairs(near.select("tid", "qid").distinct(), targets, refs)


def cosine_of_pairs(pairs: DataFrame, targets: DataFrame, refs: DataFrame) -> DataFrame:
    """(tid, qid, score): cosine over all tokens of given pairs; 0 where they share none."""
    a, b = targets.withColumnRenamed("w", "a"), refs.withColumnRenamed("w", "b")
    sums = pairs.join(a, "tid").join(b, ["qid", "token"]).groupBy("tid", "qid").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("score"))
    return pairs.join(sums, ["tid", "qid"], "left").select("tid", "qid", F.coalesce("score", F.lit(0.0)).alias("score"))


def best_by_cosine(targets: DataFrame, refs: DataFrame, makers: DataFrame, k: int, block: int = 50_000) -> DataFrame:
    """(tid, qid, score): the k best of cosine_all_tokens() for each target, for short lists of tokens.

    The references of a token of makers meet its targets as a product of two matrices, and only the k best of each
    target and token move on: any of the k best of all is among those of a token that it shares. Rows carry all their
    tokens (as hashes of 64 bits) and weights. A token with more than block targets is several groups.
    """
    counts = targets.groupBy("token").agg(F.count("*").alias("dt"))
    groups = makers.select("token").join(counts, "token").select("token", (F.floor(F.col("dt") / block) + 1).cast("int").alias("parts"))

    def placed(df: DataFrame, key: str, side: int) -> DataFrame:
        entry = F.struct(F.xxhash64("token").alias("h"), "w", "parts")
        rows = df.join(groups, "token", "left").groupBy(F.col(key).alias("id")).agg(F.collect_list(entry).alias("v"))
        out = rows.select("id", F.explode(F.filter("v", lambda x: x["parts"].isNotNull())).alias("m"), F.col("v.h").alias("hs"), F.col("v.w").alias("ws"))
        every = F.sequence(F.lit(0), F.col("m.parts") - 1)
        part = F.explode(every) if side == 0 else F.pmod(F.xxhash64("id"), F.col("m.parts")).cast("int")
        return out.select(F.col("m.h").alias("token"), part.alias("part"), F.lit(side).alias("side"), F.col("id").cast("long"), "hs", "ws")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, known = None, [], None  # the group, its references, and their vocabulary, matrix and ids
        for batch in batches:
            token, part, side, ids = (batch.column(c).to_numpy() for c in ("token", "part", "side", "id"))
            new = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1
            bounds = [0, *new.tolist(), len(token)]
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                if start == stop:
                    continue
                if (key := (token[start], part[start])) != group:
                    group, held, known = key, [], None
                rows = batch.slice(start, stop - start)
                hs, ws = (rows.column(c).flatten().to_numpy() for c in ("hs", "ws"))
                at = np.repeat(np.arange(len(rows)), rows.column("hs").value_lengths().to_numpy())
                if side[start] == 0:
                    held.append((ids[start:stop], at, hs, ws))
                    continue
                if known is None and held:
                    first = np.cumsum([0, *(len(x[0]) for x in held)])
                    words, place = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
                    m = np.zeros((first[-1], len(words)))
                    m[np.concatenate([x[1] + n for x, n in zip(held, first, strict=False)]), place] = np.concatenate([x[3] for x in held])
                    qid = np.concatenate([x[0] for x in held])
                    order = np.argsort(qid, kind="stable")
                    known = words, m[order], qid[order]
                if known is None:
                    continue
                words, m, qid = known
                for low in range(0, len(rows), 2_000):
                    own = (at >= low) & (at < low + 2_000)
                    place = np.minimum(np.searchsorted(words, hs[own]), len(words) - 1)
                    shared = words[place] == hs[own]
                    x = np.zeros((min(2_000, len(rows) - low), len(words)))
                    x[at[own][shared] - low, place[shared]] = ws[own][shared]
                    # Rounded scores and places are one whole number, so equal scores go to the smaller id.
                    rank = np.rint(x @ m.T * 1e6).astype(np.int64) * len(qid) + np.arange(len(qid))[::-1]
                    if len(qid) > k:
                        rank = np.partition(rank, len(qid) - k, axis=1)[:, -k:]
                    yield pa.record_batch(
                        [pa.array(np.repeat(ids[start:stop][low : low + 2_000], rank.shape[1])), pa.array(qid[len(qid) - 1 - rank % len(qid)].ravel()), pa.array((rank // len(qid) / 1e6).ravel())],
                        names=["tid", "qid", "score"],
                    )

    dealt = placed(refs, "qid", 0).unionByName(placed(targets, "tid", 1)).repartition("token", "part").sortWithinPartitions("token", "part", "side")
    near = dealt.mapInArrow(run, "tid long, qid long, score double").groupBy("tid", "qid").agg(F.max("score").alias("score"))
    return compete.top_k(near, "tid", k, F.desc("score"), F.asc("qid"))


def best_by_sets(targets: DataFrame, refs: DataFrame, idf: DataFrame, k: int, longest: int = 8) -> DataFrame:
    """(tid, qid, score): the k best of all references that share a token, for sets of few tokens (tid|qid, token).

    idf: (token, idf). With S the tokens that both share, the score is a sum over S divided by both lengths, so for each S only
    references count that fewer than k others surpass by their length and their id. Each row is entered under all subsets
    of its tokens; a pair's score is the largest that it gets under any. Rows of more than longest tokens meet all others that share
    a token instead.
    """

    def rows(df: DataFrame, key: str) -> DataFrame:
        v = df.distinct().join(idf, "token").groupBy(F.col(key).cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct("token", "idf"))).alias("v"))
        return v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["idf"] * x["idf"])))

    def subsets(df: DataFrame, side: int) -> DataFrame:
        every = F.explode(F.expr("transform(sequence(1, shiftleft(1, size(v)) - 1), m -> filter(v, (x, i) -> (shiftright(m, i) & 1) = 1))"))
        own = F.aggregate("x", F.lit(0.0), lambda a, y: a + y["idf"] * y["idf"]) / F.col("norm") if side else F.col("norm")
        return df.select("id", "norm", every.alias("x")).select(F.xxhash64("x.token").alias("h"), F.lit(side).alias("side"), "id", own.alias("x"))

    q, t = stored(rows(refs, "qid")), stored(rows(targets, "tid"))
    # Equal sets of targets are asked once, by the smallest id.
    sets = t.groupBy("v", "norm").agg(F.min("id").alias("id"))
    short = F.size("v") <= longest
    met = subsets(q.where(short), 0).unionByName(subsets(sets.where(short), 1))
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.repartition(n, "h").sortWithinPartitions("h", "side", "x", "id").mapInArrow(lambda b: best_of_sets(b, k), "tid long, qid long, score double")
    if not q.where(~short).isEmpty() or not sets.where(~short).isEmpty():
        w = F.explode("v").alias("e"), "norm", short.alias("short")
        a, b = (x.select("id", *w).select(F.col("id").alias(i), "short", "e.token", (F.col("e.idf") / F.col("norm")).alias(c)) for x, i, c in ((sets, "tid", "a"), (q, "qid", "b")))
        for x, y in ((a.where("NOT short"), b), (a.where("short"), b.where("NOT short"))):
            all_pairs = x.drop("short").join(y.drop("short"), "token").groupBy("tid", "qid").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("score"))
            found = found.unionByName(all_pairs)
    best = compete.top_k(found.groupBy("tid", "qid").agg(F.max("score").alias("score")), "tid", k, F.desc("score"), F.asc("qid"))
    asked = t.select(F.col("id").alias("own"), "v", "norm").join(sets, ["v", "norm"]).select("own", F.col("id").alias("tid"))
    return asked.join(best.select("tid", "qid", "score"), "tid").select(F.col("own").alias("tid"), "qid", "score")


def best_of_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of rows (h, side, id, x) by h, side, x and id: the k best references (side 0, x their length) of each target (side 1)."""
    h, held, heap, known = None, [], [], None
    for batch in batches:
        keys, sides, ids, xs = (batch.column(c).to_numpy() for c in ("h", "side", "id", "x"))
        new = np.flatnonzero((keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])) + 1
        out = [], [], []
        for start, stop in zip([0, *new.tolist()], [*new.tolist(), len(keys)], strict=True):
            if start == stop:
                continue
            if keys[start] != h:
                h, held, heap, known = keys[start], [], [], None
            if sides[start] == 0:
                for i, x in zip(ids[start:stop].tolist(), xs[start:stop].tolist(), strict=True):
                    # heap: the k smallest ids so far, negative; rows come by ascending length.
                    if len(heap) < k:
                        heapq.heappush(heap, -i)
                    elif i < -heap[0]:
                        heapq.heapreplace(heap, -i)
                    else:
                        continue
                    held.append((i, x))
                continue
            if not held:
                continue
            if known is None:
                held.sort()
                known = np.array([i for i, _ in held], np.int64), np.array([x for _, x in held])
            qid, norm = known
            for low in range(start, stop, 10_000):
                own = slice(low, min(stop, low + 10_000))
                # Rounded scores and places are one whole number, so equal scores go to the smaller id.
                rank = np.rint(xs[own, None] / norm * 1e6).astype(np.int64) * len(qid) + np.arange(len(qid))[::-1]
                if len(qid) > k:
                    rank = np.partition(rank, len(qid) - k, axis=1)[:, -k:]
                for column, y in zip(out, (np.repeat(ids[own], rank.shape[1]), qid[len(qid) - 1 - rank % len(qid)].ravel(), (rank // len(qid) / 1e6).ravel()), strict=True):
                    column.append(y)
        if out[0]:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=["tid", "qid", "score"])


def exact_keys(targets: DataFrame, refs: DataFrame, keys: list[str], most_owners: int | None = None) -> DataFrame:
    """Pairs with equal keys; with most_owners, only keys that so many references share at most."""
    if most_owners is not None:
        refs = refs.join(refs.groupBy(*keys).agg(F.count("*").alias("owners")).where(F.col("owners") <= most_owners), keys)
    return targets.join(refs.select("qid", *keys), keys).select("tid", "qid")


def rare_witnesses(targets: DataFrame, refs: DataFrame, most_owners: int, most_targets: int) -> DataFrame:
    """(tid, qid, witnesses, support): pairs that share tokens rare on both sides.

    support is the sum of 1 / sqrt(df of references * df of targets). Inputs: (tid, token) and (qid, token).
    """
    a = targets.distinct().join(targets.distinct().groupBy("token").agg(F.count("*").alias("dt")).where(F.col("dt") <= most_targets), "token")
    b = refs.distinct().join(refs.distinct().groupBy("token").agg(F.count("*").alias("dr")).where(F.col("dr") <= most_owners), "token")
    return a.join(b, "token").groupBy("tid", "qid").agg(
        F.count("*").alias("witnesses"), F.round(F.sum(1 / F.sqrt(F.col("dr") * F.col("dt"))), 6).alias("support")
    )


def rank_fusion(lanes: list[DataFrame], offset: int = 20) -> DataFrame:
    """(tid, qid, rrf): sum over lanes (tid, qid, rank) of 1 / (offset + rank)."""
    union = lanes[0].select("tid", "qid", "rank")
    for lane in lanes[1:]:
        union = union.unionByName(lane.select("tid", "qid", "rank"))
    return union.groupBy("tid", "qid").agg(F.round(F.sum(1 / (offset + F.col("rank"))), 9).alias("rrf"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def exact_neighbours(queries: DataFrame, rows: DataFrame, k: int, block: int = 1_000, part: int = 20_000) -> DataFrame:
    """(qid, vid, rank, score): the k rows of greatest cosine to each query, over all rows.

    queries (qid, q) is a stated set. Blocks of about block queries meet parts of about part rows as products of two
    matrices; of each, k rows a query move on. No task holds more than one block and one part.
    """
    blocks, parts = (max(1, -(-x.count() // n)) for x, n in ((queries, block), (rows, part)))

    def placed(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        place = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own)
        return df.select("*", place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def unit(lists: pa.ChunkedArray) -> np.ndarray:
        x = np.array(lists.to_pylist(), np.float64)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def nearest(q: pa.Table, v: pa.Table) -> pa.Table:
        out = {"qid": [], "vid": [], "score": []}
        if len(q) and len(v):
            qid, vid = q["qid"].to_numpy(), v["vid"].to_numpy()
            score = np.round(unit(q["q"]) @ unit(v["v"]).T, 6)
            score[qid[:, None] == vid[None]] = -np.inf
            order = np.lexsort((np.broadcast_to(vid, score.shape), -score), axis=1)[:, :k]
            best = np.take_along_axis(score, order, 1)
            kept = np.isfinite(best)
            out = {"qid": np.repeat(qid, kept.sum(1)), "vid": vid[order][kept], "score": best[kept]}
        return pa.table({"qid": pa.array(out["qid"], pa.int64()), "vid": pa.array(out["vid"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    q, v = placed(queries, "qid", "block", blocks, "part", parts), placed(rows, "vid", "part", parts, "block", blocks)
    near = q.groupBy("block", "part").cogroup(v.groupBy("block", "part")).applyInArrow(nearest, "qid long, vid long, score double")
    return compete.ranked(near, "qid", F.desc("score"), F.asc("vid")).where(F.col("rank") <= k)


def union_scores(left: DataFrame, right: DataFrame, missing: float) -> DataFrame:
    """Pairs of either side; a score that one lacks gets the default, and ``outside`` marks pairs of the right only."""
    out = left.withColumn("_l", F.lit(True)).join(right, ["tid", "qid"], "full")
    return out.select("tid", "qid", F.coalesce("p", F.lit(missing)).alias("p"), F.coalesce("ext", F.lit(missing)).alias("ext"), F.col("_l").isNull().alias("outside"))


def recall_at(pairs: DataFrame, targets: DataFrame, ks: list[int]) -> DataFrame:
    """(k, owned, found, recall): owned targets whose owner is among their first k pairs (tid, qid, rank)."""
    truth = targets.where("own >= 0").select("tid", F.col("own").alias("qid"))
    hit = truth.join(pairs, ["tid", "qid"], "left")
    sums = hit.agg(F.count("*").alias("owned"), *[F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks])
    rows = sums.select("owned", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("found")) for k in ks])).alias("x"))
    return rows.select("x.k", "owned", "x.found", F.try_divide(F.col("x.found"), F.col("owned")).alias("recall"))


def hashed(tokens: Column, field: int = 0) -> Column:
    """64-bit hashes of tokens, apart for each field; none of null."""
    return F.coalesce(F.transform(tokens, lambda x: F.xxhash64(F.lit(field), x)), F.array().cast("array<bigint>"))


def rows_by_id(df: DataFrame) -> DataFrame:
    """(id, co, h): one row for each id and country; where ids repeat, with the tokens of all their rows in each field."""
    if df.groupBy("id", "co").count().where("count > 1").isEmpty():
        return df
    fields = df.select("id", "co", F.posexplode("h").alias("field", "x")).groupBy("id", "co", "field").agg(F.array_distinct(F.flatten(F.collect_list("x"))).alias("x"))
    return fields.groupBy("id", "co").agg(F.transform(F.array_sort(F.collect_list(F.struct("field", "x"))), lambda v: v["x"]).alias("h"))


def slots(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of so many entries each, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class Weighted:
    """Rows of a cell by ascending id, with weights of length 1 in each field: entries (row, place of the token, field, w)."""

    def __init__(self, pieces: list[pa.RecordBatch], words: np.ndarray, idf: np.ndarray) -> None:
        ids = np.concatenate([x.column("id").to_numpy() for x in pieces])
        order = np.argsort(ids, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        row, field, h, first = [], [], [], 0
        for x in pieces:
            column = x.column("h")
            counts, lists = column.value_lengths().to_numpy(), column.flatten()
            n = lists.value_lengths().to_numpy()
            row.append(np.repeat(rank[first + np.repeat(np.arange(len(x)), counts)], n))
            field.append(np.repeat(slots(np.zeros(len(counts), np.int64), counts.astype(np.int64)), n))
            h.append(lists.flatten().to_numpy())
            first += len(x)
        row, field, h = (np.concatenate(v) for v in (row, field, h))
        place = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
        known = words[place] == h if len(words) else np.zeros(len(h), bool)
        order2 = np.flatnonzero(known)[np.argsort(row[known], kind="stable")]
        self.ids, self.row, self.place, self.field = ids[order], row[order2], place[order2], field[order2]
        self.fields = int(field.max(initial=0)) + 1
        w, key = idf[self.place], self.row * self.fields + self.field
        self.w = w / np.sqrt(np.bincount(key, w * w, len(ids) * self.fields))[key]
        self.bounds = np.searchsorted(self.row, np.arange(len(ids) + 1))


def best_in_cells(targets: DataFrame, refs: DataFrame, idf: DataFrame, k: int, most: int = 40_000, least_parts: int = 1) -> DataFrame:
    """(tid, qid, cosines, score): the k best references of each target by the sum of the cosines of their fields.

    targets and refs: (id, co, h), h with an array of distinct hashed tokens for each field; idf: (co, h, idf, makes).
    Rows meet within a country if they share a token that makes candidates, and all tokens count in scores. A country's
    rows are dealt to parts of about most rows, at least least_parts on each side, and each two parts are a cell. Within it the
    lists of making tokens give each candidate a part of its score; the rest is at most the product of the lengths of
    both rows' other weights. Candidates that could be among the k best are scored exactly.
    """
    counts = refs.groupBy("co").agg(F.count("*").alias("q")).join(targets.groupBy("co").agg(F.count("*").alias("t")), "co")
    parts = counts.select("co", *[F.greatest(F.lit(least_parts), F.ceil(F.col(c) / most)).cast("int").alias(c) for c in ("q", "t")])

    def dealt(df: DataFrame, own: str | None) -> DataFrame:
        out = df.join(F.broadcast(parts), "co")  # one row for each country
        for c in ("q", "t"):
            out = out.withColumn(c, part_of("id", F.col(c)) if c == own else F.explode(F.sequence(F.lit(0), F.col(c) - 1)))
        return out.withColumn("cell", F.xxhash64("co", "q", "t"))

    out = "tid long, qid long, cosines array<double>, score double"
    near = in_cells(dealt(packed_idf(idf), None), dealt(refs, "q"), dealt(targets, "t")).mapInArrow(CellIndex.reader(k), out)
    return compete.top_k(near, "tid", k, F.desc("score"), F.asc("qid"))


def cosine_in_cells(pairs: DataFrame, targets: DataFrame, refs: DataFrame, idf: DataFrame, most: int = 20_000) -> DataFrame:
    """(tid, qid, score): the cosine over all tokens of given pairs (tid, qid); 0 where they share none.

    targets, refs and idf as for best_in_cells(), of one country. References are dealt to parts of about most rows, and a target goes
    to the parts that hold references of its pairs.
    """
    parts = F.lit(max(1, -(-refs.count() // most)))
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    asked = pairs.withColumn("cell", part_of("qid", parts)).groupBy("cell", F.col("tid").alias("id")).agg(F.collect_list("qid").alias("asked"))
    sides = packed_idf(idf).withColumn("cell", every), refs.withColumn("cell", part_of("id", parts)), asked.join(targets, "id")
    cells = in_cells(*[x.withColumn("cell", F.col("cell").cast("long")) for x in sides])
    found = cells.mapInArrow(CellIndex.reader(0), "tid long, qid long, cosines array<double>, score double")
    return found.select("tid", "qid", "score")


def part_of(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def packed_idf(idf: DataFrame) -> DataFrame:
    """(co, id, h, idf, makes): tokens in packs, as each cell gets all of its country's."""
    packs = idf.groupBy("co", F.pmod("h", F.lit(64)).alias("id")).agg(F.collect_list(F.struct("h", "idf", "makes")).alias("x"))
    return packs.select("co", "id", F.array("x.h").alias("h"), F.col("x.idf").alias("idf"), F.col("x.makes").alias("makes"))


def in_cells(idf: DataFrame, refs: DataFrame, targets: DataFrame) -> DataFrame:
    """The three sides of each cell (cell long, id, h and what a side has of idf, makes and asked) together and in this order."""
    kinds = {"cell": "long", "id": "long", "h": "array<array<bigint>>", "idf": "array<double>", "makes": "array<boolean>", "asked": "array<bigint>"}
    sides = []
    for i, x in enumerate((idf, refs, targets)):
        sides.append(x.select(F.lit(i).alias("side"), *[(F.col(c) if c in x.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]))
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "cell").sortWithinPartitions("cell", "side")


class CellIndex:
    """The references of a cell by the tokens that make candidates."""

    def __init__(self, idf: list[pa.RecordBatch], refs: list[pa.RecordBatch], k: int) -> None:
        h = np.concatenate([np.zeros(0, np.int64), *(x.column("h").flatten().flatten().to_numpy() for x in idf)])
        w, makes = (np.concatenate([np.zeros(0), *(x.column(c).flatten().to_numpy(zero_copy_only=False) for x in idf)]) for c in ("idf", "makes"))
        order = np.argsort(h)
        self.k, self.words, self.idf, self.makes = k, h[order], w[order], makes[order].astype(bool)
        self.refs = r = Weighted(refs, self.words, self.idf)
        common = ~self.makes[r.place]
        self.rest = np.sqrt(np.bincount(r.row[common], r.w[common] ** 2, len(r.ids)))
        order = np.argsort(r.place, kind="stable")
        self.row, self.w, self.field = r.row[order], r.w[order], r.field[order]
        self.starts = np.searchsorted(r.place[order], np.arange(len(self.words) + 1))
        self.dense = np.zeros(len(self.words))

    @classmethod
    def reader(cls, k: int):
        """The function for mapInArrow over in_cells(): the k best of each target, or all that it asks for."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, held, index = None, {0: [], 1: []}, None
            for batch in batches:
                keys, sides = (batch.column(c).to_numpy() for c in ("cell", "side"))
                new = np.flatnonzero((keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])) + 1
                bounds = [0, *new.tolist(), len(keys)]
                for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                    if start == stop:
                        continue
                    if keys[start] != cell:
                        cell, held, index = keys[start], {0: [], 1: []}, None
                    piece = batch.slice(start, stop - start)
                    if sides[start] < 2:
                        held[int(sides[start])].append(piece)
                    elif held[1]:
                        index = index or cls(held[0], held[1], k)
                        held[0], held[1] = [], [piece.slice(0, 0)]
                        yield index.best(piece) if k else index.asked(piece)

        return run

    def asked(self, piece: pa.RecordBatch) -> pa.RecordBatch:
        """The cosines of given pairs, of one field."""
        order = np.argsort(piece.column("id").to_numpy(), kind="stable")
        piece = piece.take(pa.array(order))
        t, r = Weighted([piece], self.words, self.idf), self.refs
        lists = piece.column("asked")
        n, qid, score = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), []
        for near, a, b in zip(np.split(np.searchsorted(r.ids, qid), np.cumsum(n)[:-1]), t.bounds[:-1], t.bounds[1:], strict=True):
            self.dense[t.place[a:b]] = t.w[a:b]
            own = r.bounds[near + 1] - r.bounds[near]
            at = slots(r.bounds[near], own)
            score.append(np.bincount(np.repeat(np.arange(len(near)), own), self.dense[r.place[at]] * r.w[at], len(near)))
            self.dense[t.place[a:b]] = 0
        score = np.round(np.concatenate(score), 6)
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(score) + 1), pa.int32()), pa.array(score))
        return pa.record_batch([pa.array(np.repeat(t.ids, n)), pa.array(qid), each, pa.array(score)], names=["tid", "qid", "cosines", "score"])

    def best(self, piece: pa.RecordBatch) -> pa.RecordBatch:
        t, r, k = Weighted([piece], self.words, self.idf), self.refs, self.k
        fields = max(t.fields, r.fields)
        out = [], [], [], []
        for i, (a, b) in enumerate(zip(t.bounds[:-1], t.bounds[1:], strict=True)):
            place, w = t.place[a:b], t.w[a:b]
            makes, starts = self.makes[place], self.starts[place]
            lengths = self.starts[place + 1] - starts
            at = slots(starts[makes], lengths[makes])
            if not len(at):
                continue
            part = np.bincount(self.row[at], self.w[at] * np.repeat(w[makes], lengths[makes]), len(r.ids))
            near = np.flatnonzero(part)
            if len(near) > k:
                x = part[near]
                least = np.partition(x, len(x) - k)[len(x) - k] - 1e-5  # more than rounding may take away
                near = near[x + np.sqrt((w[~makes] ** 2).sum()) * self.rest[near] >= least]
            own = r.bounds[near + 1] - r.bounds[near]
            if own.sum() > lengths.sum():  # so many are left that the lists of all the target's tokens are shorter than their rows
                at = slots(starts, lengths)
                sums = np.bincount(self.row[at] * fields + self.field[at], self.w[at] * np.repeat(w, lengths), len(r.ids) * fields)
                sums = sums.reshape(-1, fields)[near]
            else:
                self.dense[place] = w
                at = slots(r.bounds[near], own)
                key = np.repeat(np.arange(len(near)), own) * fields + r.field[at]
                sums = np.bincount(key, self.dense[r.place[at]] * r.w[at], len(near) * fields).reshape(-1, fields)
                self.dense[place] = 0
            cosines = np.round(sums, 6)
            score = np.round(cosines.sum(1), 6)
            first = np.lexsort((near, -score))[:k]
            for column, x in zip(out, (np.full(len(first), t.ids[i]), r.ids[near[first]], cosines[first].ravel(), score[first]), strict=True):
                column.append(x)
        tid, qid, cosines, score = (np.concatenate(x) if x else np.zeros(0) for x in out)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(score) + 1) * fields, pa.int32()), pa.array(cosines))
        return pa.record_batch([pa.array(tid.astype(np.int64)), pa.array(qid.astype(np.int64)), lists, pa.array(score)], names=["tid", "qid", "cosines", "score"])


def reference_idf(refs: DataFrame, least: int = 1) -> DataFrame:
    """(co, h, idf, makes) of the tokens of references (id, co, h) of one field and one country, as smoothed_idf() and share_cap() have it."""
    n = refs.where(F.size(F.flatten("h")) > 0).count()
    df = refs.select("co", F.explode(F.flatten("h")).alias("h")).groupBy("co", "h").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return df.select("co", "h", (F.ln(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1).alias("idf"), (F.col("df") <= share_cap(n, least)).alias("makes"))


def field_idf(refs: DataFrame, targets: DataFrame, least: int) -> DataFrame:
    """(co, h, idf, makes) of the tokens of both sides (id, co, h).

    idf = ln((n + 1) / (df + 1)) + 1 with n and the frequency on both sides in a country. A token makes candidates if 3 % of the
    country's references have it at most (2,000 at most, least at least).
    """
    both = refs.select("co", "h", F.lit(1).alias("side")).unionByName(targets.select("co", "h", F.lit(2).alias("side")))
    own = F.count_if(F.col("side") == 1)
    sizes = both.groupBy("co").agg(F.count("*").alias("n"), own.alias("n1"))
    df = both.select("co", "side", F.explode(F.flatten("h")).alias("h")).groupBy("co", "h").agg(F.count("*").alias("df"), own.alias("df1"))
    most = F.greatest(F.lit(least), F.least(F.lit(2000), F.expr("n1 * 3 div 100")))
    return df.join(F.broadcast(sizes), "co").select("co", "h", (F.col("df1") <= most).alias("makes"), (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def field_neighbours(refs: DataFrame, targets: DataFrame, least: int, k: int) -> DataFrame:
    """(tid, qid, name_cos, address_cos, score): the k best references of each target by the sum of both fields' cosines.

    refs and targets: (id, co, h) with the distinct hashed tokens of name and address. Records meet within a country.
    Common tokens make no candidates but count in scores, which are exact for every candidate.
    """
    refs, targets = rows_by_id(refs), rows_by_id(targets)
    best = best_in_cells(targets, refs, field_idf(refs, targets, least), k)
    return best.select("tid", "qid", *[F.col("cosines")[i].alias(c) for i, c in enumerate(("name_cos", "address_cos"))], "score")


#: Odd numbers that make one of 64 bits from the four letters of a run.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the runs of four letters of one row's texts."""
    runs = []
    for t in texts:
        x = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(x) >= 4:
            runs.append(x[:-3] * MIX[0] + x[1:-2] * MIX[1] + x[2:-1] * MIX[2] + x[3:] * MIX[3])
    h = np.concatenate([np.zeros(0, np.uint64), *runs])
    h.sort()
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    return h[first].view(np.int64), np.diff(np.append(first, len(h)))


def gram_idf(refs: DataFrame, least: int) -> DataFrame:
    """(co, h, idf, makes) of the runs that least references (id, texts) have or more, as smoothed_idf() has it; all make candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 2_000):
                own = [gram_counts(t)[0] for t in batch.column("texts").slice(low, 2_000).to_pylist()]
                h = np.sort(np.concatenate(own))
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
                h, df = np.append(h[first], 0), np.append(np.diff(np.append(first, len(h))), 0)
                rows = np.append(np.zeros(len(first), np.int64), sum(len(x) > 0 for x in own))
                yield pa.record_batch([pa.array(h), pa.array(df), pa.array(rows)], names=["h", "df", "n"])

    # The last row of a batch has no run, but how many references have any.
    counts = refs.select("texts").mapInArrow(run, "h long, df long, n long").groupBy("h").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    counts = stored(counts)
    n = counts.agg(F.sum("n")).first()[0] or 0
    idf = (F.ln(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1).alias("idf")
    return counts.where(F.col("df") >= max(1, least)).select(F.lit("").alias("co"), "h", idf, F.lit(True).alias("makes"))


def best_by_grams(targets: DataFrame, refs: DataFrame, k: int, least: int, most: int = 4_000, ref_parts: int = 4) -> DataFrame:
    """(tid, qid, score): the k best references of each target by the cosine of all runs of four letters in their texts.

    targets and refs: (id, co, texts). All references that share a run with a target are compared with it. Targets are
    dealt to parts of about most rows and references to ref_parts, each two parts meet as a cell; co only puts
    rows side by side that have much in common. Whole texts go to the cells, as they take less room than their runs.
    """
    idf = packed_idf(gram_idf(refs, least))
    sizes = {"t": max(2, -(-targets.count() // most)), "q": ref_parts}

    def dealt(df: DataFrame, own: str | None) -> DataFrame:
        for c, n in sizes.items():
            df = df.withColumn(c, part_of("id", F.lit(n)) if c == own else F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return df.withColumn("cell", F.col("t") * ref_parts + F.col("q"))

    kinds = {"cell": "int", "id": "long", "co": "string", "h": "array<bigint>", "idf": "array<double>", "texts": "array<string>"}
    sides = [dealt(idf.withColumn("h", F.col("h")[0]), None), dealt(targets, "t"), dealt(refs, "q")]
    rows = [x.select(F.lit(i).alias("side"), *[(F.col(c) if c in x.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]) for i, x in enumerate(sides)]
    cells = rows[0].unionByName(rows[1]).unionByName(rows[2]).repartitionById(sizes["t"] * ref_parts, F.col("cell")).sortWithinPartitions("cell", "side", "co", "id")
    near = cells.mapInArrow(GramCell.reader(k), "tid long, qid long, score double")
    return compete.top_k(near, "tid", k, F.desc("score"), F.asc("qid"))


class Grams:
    """Rows by their runs that are in words: entries (row, place, w) in order of rows, w of length 1 for each row."""

    def __init__(self, ids: np.ndarray, texts: list, words: np.ndarray, idf: np.ndarray) -> None:
        place, w, sizes = [], [], []
        for t in texts:
            h, n = gram_counts(t)
            at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
            known = words[at] == h if len(words) else np.zeros(len(h), bool)
            at = at[known]
            x = (1 + np.log(n[known])) * idf[at]
            place.append(at.astype(np.int32))
            w.append(x / np.sqrt((x * x).sum()) if len(x) else x)
            sizes.append(len(x))
        self.ids, self.place, self.w = ids, np.concatenate(place), np.concatenate(w)
        self.bounds = np.cumsum([0, *sizes])
        self.row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self.counts = np.bincount(self.place, minlength=len(words))

    def dense(self, column: np.ndarray, n: int) -> np.ndarray:
        """The columns of places that have one."""
        out, c = np.zeros((len(self.ids), n)), column[self.place]
        own = np.flatnonzero(c >= 0)
        out[self.row[own], c[own]] = self.w[own]
        return out


class GramCell:
    """The targets of a cell, and the k best of the references that have come by."""

    makes = None  # which runs make candidates: all
    ROWS, SPARSE = 2_000, 1_000  # rows of a block; what a product of two entries costs against one of two matrices

    def __init__(self, idf: list[pa.RecordBatch], targets: list[pa.RecordBatch], k: int) -> None:
        h = np.concatenate([np.zeros(0, np.int64), *(x.column("h").flatten().to_numpy() for x in idf)])
        w = np.concatenate([np.zeros(0), *(x.column("idf").flatten().to_numpy() for x in idf)])
        order = np.argsort(h)
        self.k, self.words, self.idf = k, h[order], w[order]
        self.blocks = [self.grams(x) for x in self.cut(targets)]
        self.best = [(np.full((len(b.ids), k), -1), np.zeros((len(b.ids), k), np.int64)) for b in self.blocks]

    def grams(self, rows: pa.Table) -> Grams:
        return Grams(rows["id"].to_numpy(), rows["texts"].to_pylist(), self.words, self.idf)

    @classmethod
    def cut(cls, pieces: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Blocks of rows of one co."""
        rows = pa.Table.from_batches(pieces).combine_chunks()
        co = rows["co"].to_numpy()
        new = np.flatnonzero(co[1:] != co[:-1]) + 1
        for start, stop in zip([0, *new.tolist()], [*new.tolist(), len(co)], strict=True):
            for low in range(start, stop, cls.ROWS):
                yield rows.slice(low, min(cls.ROWS, stop - low))

    @classmethod
    def reader(cls, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, held, index, waiting = None, {0: [], 1: []}, None, []

            def done() -> Iterator[pa.RecordBatch]:
                if index is not None:
                    if waiting:
                        index.meet(waiting)
                    yield index.result()

            for batch in batches:
                keys, sides = (batch.column(c).to_numpy() for c in ("cell", "side"))
                new = np.flatnonzero((keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])) + 1
                bounds = [0, *new.tolist(), len(keys)]
                for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                    if start == stop:
                        continue
                    if keys[start] != cell:
                        yield from done()
                        cell, held, index, waiting = keys[start], {0: [], 1: []}, None, []
                    piece = batch.slice(start, stop - start)
                    if sides[start] < 2:
                        held[int(sides[start])].append(piece)
                    elif held[1]:
                        if index is None:
                            index = cls(held[0], held[1], k)
                            held[0] = []
                        waiting.append(piece)
                        if sum(map(len, waiting)) >= 2 * cls.ROWS:
                            index.meet(waiting)
                            waiting = []
            yield from done()

        return run

    def meet(self, pieces: list[pa.RecordBatch]) -> None:
        for rows in self.cut(pieces):
            r = self.grams(rows)
            order = np.argsort(r.place, kind="stable")
            lists = r.row[order], r.w[order], np.concatenate([[0], np.cumsum(r.counts)])
            for t, best in zip(self.blocks, self.best, strict=True):
                self.compare(t, r, lists, best)

    def compare(self, t: Grams, r: Grams, lists: tuple, best: tuple) -> None:
        """Common runs meet as a product of two matrices, the others by their lists."""
        nt, nr = len(t.ids), len(r.ids)
        meets = t.counts * r.counts
        chosen = np.flatnonzero(meets * self.SPARSE > nt * nr)
        column = np.full(len(self.words) + 1, -1, np.int32)
        column[chosen] = np.arange(len(chosen))
        score = t.dense(column, len(chosen)) @ r.dense(column, len(chosen)).T
        rest = meets > 0
        rest[chosen] = False
        at = np.flatnonzero(rest[t.place])
        row, w, starts = lists
        lengths = starts[t.place[at] + 1] - starts[t.place[at]]
        ends = np.cumsum(lengths)
        first = 0
        while first < len(at):  # about two million products at once, whole rows of targets
            last = np.searchsorted(t.row[at], t.row[at[min(len(at) - 1, max(first, np.searchsorted(ends, (ends[first - 1] if first else 0) + 2_000_000)))]], "right")
            own, n = at[first:last], lengths[first:last]
            low, high = int(t.row[own[0]]), int(t.row[own[-1]]) + 1
            places = slots(starts[t.place[own]], n)
            key = np.repeat((t.row[own] - low).astype(np.int64) * nr, n) + row[places]
            score[low:high] += np.bincount(key, w[places] * np.repeat(t.w[own], n), (high - low) * nr).reshape(high - low, nr)
            first = last
        # Rounded scores and places are one whole number, so equal scores go to the smaller id.
        rank = np.rint(score * 1e6).astype(np.int64) * nr + np.arange(nr)[::-1]
        rank[~self.candidates(t, r, lists) if self.makes is not None else score <= 0] = -1
        if nr > self.k:
            rank = np.partition(rank, nr - self.k, axis=1)[:, nr - self.k :]
        s = np.concatenate([best[0], np.where(rank < 0, -1, rank // nr)], axis=1)
        q = np.concatenate([best[1], r.ids[nr - 1 - rank % nr]], axis=1)
        order = np.lexsort((q, -s), axis=1)[:, : self.k]
        best[0][:], best[1][:] = np.take_along_axis(s, order, 1), np.take_along_axis(q, order, 1)

    def result(self) -> pa.RecordBatch:
        tid, score, qid = (np.concatenate(x) for x in ([np.repeat(b.ids, self.k) for b in self.blocks], [s.ravel() for s, _ in self.best], [q.ravel() for _, q in self.best]))
        own = score >= 0
        return pa.record_batch([pa.array(tid[own]), pa.array(qid[own]), pa.array(score[own] / 1e6)], names=["tid", "qid", "score"])


def best_by_words(targets: DataFrame, refs: DataFrame, idf: DataFrame, k: int, most: int = 30_000, ref_most: int = 80_000) -> DataFrame:
    """(tid, qid, score): best_in_cells() of one field and one country, for long rows: blocks of rows meet as in best_by_grams()."""
    sizes = {"t": max(3, -(-targets.count() // most)), "q": max(3, -(-refs.count() // ref_most))}

    def dealt(df: DataFrame, own: str | None) -> DataFrame:
        for c, n in sizes.items():
            df = df.withColumn(c, part_of("id", F.lit(n)) if c == own else F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return df.withColumn("cell", F.col("t") * sizes["q"] + F.col("q"))

    kinds = {"cell": "int", "id": "long", "h": "array<bigint>", "idf": "array<double>", "makes": "array<boolean>"}
    sides = [x.withColumn("h", F.flatten("h")) for x in (dealt(packed_idf(idf), None), dealt(targets, "t"), dealt(refs, "q"))]
    rows = [x.select(F.lit(i).alias("side"), *[(F.col(c) if c in x.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]) for i, x in enumerate(sides)]
    cells = rows[0].unionByName(rows[1]).unionByName(rows[2]).repartitionById(sizes["t"] * sizes["q"], F.col("cell")).sortWithinPartitions("cell", "side", "id")
    near = cells.mapInArrow(WordCell.reader(k), "tid long, qid long, score double")
    return compete.top_k(near, "tid", k, F.desc("score"), F.asc("qid"))


class Words(Grams):
    """Rows by their distinct words, numbered by number: those without one count in lengths only."""

    def __init__(self, rows: pa.Table, words: np.ndarray, idf: np.ndarray, number: np.ndarray | None, makes: np.ndarray) -> None:
        column = rows["h"].combine_chunks()
        h, row = column.flatten().to_numpy(), np.repeat(np.arange(len(rows)), column.value_lengths().to_numpy())
        at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
        known = words[at] == h if len(words) else np.zeros(len(h), bool)
        at, row = at[known], row[known]
        w = idf[at]
        w = w / np.sqrt(np.bincount(row, w * w, len(rows)))[row]
        if number is not None:
            at = number[at]
            own = at >= 0
            at, row, w = at[own], row[own], w[own]
        self.ids, self.place, self.w, self.row = rows["id"].to_numpy(), at, w, row.astype(np.int32)
        if number is not None:
            self.counts = np.bincount(at, minlength=len(makes)).astype(np.int32)


class WordCell(GramCell):
    """GramCell for words of which some make no candidates."""

    def __init__(self, idf: list[pa.RecordBatch], targets: list[pa.RecordBatch], k: int) -> None:
        h = np.concatenate([np.zeros(0, np.int64), *(x.column("h").flatten().to_numpy() for x in idf)])
        w, makes = (np.concatenate([np.zeros(0), *(x.column(c).flatten().to_numpy(zero_copy_only=False) for x in idf)]) for c in ("idf", "makes"))
        order = np.argsort(h)
        self.k, self.all_words, self.idf, makes = k, h[order], w[order], makes[order].astype(bool)
        blocks = list(self.cut(targets))
        self.number = np.full(len(h), -1, np.int32)
        for x in blocks:
            self.number[Words(x, self.all_words, self.idf, None, makes).place] = 0
        own = np.flatnonzero(self.number == 0)
        self.number[own] = np.arange(len(own))
        self.words, self.makes = own, makes[own]
        self.blocks = [self.grams(x) for x in blocks]
        self.best = [(np.full((len(b.ids), k), -1), np.zeros((len(b.ids), k), np.int64)) for b in self.blocks]

    def grams(self, rows: pa.Table) -> Words:
        return Words(rows, self.all_words, self.idf, self.number, self.makes)

    @classmethod
    def cut(cls, pieces: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        rows = pa.Table.from_batches(pieces).combine_chunks()
        for low in range(0, len(rows), cls.ROWS):
            yield rows.slice(low, cls.ROWS)

    def candidates(self, t: Grams, r: Grams, lists: tuple) -> np.ndarray:
        """Whether rows share a word that makes candidates."""
        nr = len(r.ids)
        out = np.zeros(len(t.ids) * nr, bool)
        at = np.flatnonzero(self.makes[t.place])
        starts = lists[2]
        n = starts[t.place[at] + 1] - starts[t.place[at]]
        out[np.repeat(t.row[at].astype(np.int64) * nr, n) + lists[0][slots(starts[t.place[at]], n)]] = True
        return out.reshape(-1, nr)
