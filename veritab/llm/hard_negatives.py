"""Hard-negative mining over inverted lists, exactly.

Vectors are made whole numbers and dealt into clusters by k-means, fitted on a bounded sample; every vector is in the
list of its nearest centroid, and with each centroid the radius of its cluster is kept. For an anchor a and a cluster
with centroid c and radius r, no score is above <a, c> + |a| r nor below <a, c> - |a| r (Cauchy-Schwarz). Clusters are
visited by descending upper bound, in rounds of growing size. A cluster whose bounds lie outside the window of scores
asked for is never visited, and none whose bound is strictly below the k-th score found so far, so ties are still met.

A visit is a row: a block of anchors for one part of a cluster's list. It meets that part by a join, and a task scores
blocks by matrix products. Lists are cut into parts of about LIST vectors, so a cluster of a third of all vectors is
many parts. What is found goes through one ranking by anchor and window, of which Spark keeps the first k in each task
before it shuffles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.common import bounded_batches, discard, stored
from veritab.llm.linear import sample_by_hash, size_within

POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score, in percent of the positive's.
LOW, HIGH = 30, 90
#: Vectors that the centroids are fitted on, and passes over them. Every vector is indexed.
SAMPLE, PASSES = 10_000, 8
#: Clusters: half the square root of the number of vectors, and no more centroids than fit these bytes, which every task gets.
MOST_CLUSTERS, CENTROID_BYTES = 1024, 32 << 20
#: Vectors of one part of a list, and anchors of one visit.
LIST, BLOCK = 2048, 256
#: Clusters of the first round; each round goes so many times as far.
FIRST, GROWTH = 8, 8
#: Larger components or more of them may have scores that 64 bits don't hold.
LARGEST, WIDEST = 1 << 24, 1 << 14
NONE = -(1 << 63)


def whole_vectors(df: DataFrame) -> tuple[DataFrame, int]:
    """((vec_id, label, v), width): components floor(256 x) as 32-bit numbers, zeros up to the longest vector's width.

    Rows without vec_id, label or vector, with a component that is null, not finite or beyond 65,536, or with more than
    16,384 components are left out. Where 7 divides vec_id the label is moved by one. A repeated vec_id counts once, with
    its smallest label and then vector.
    """
    own = df.select(df["vec_id"].cast("long").alias("vec_id"), df["label"].cast("long").alias("label"), df["embedding"].cast("array<double>").alias("x"))
    own = own.where("vec_id is not null and label is not null and x is not null").where(F.size("x") <= WIDEST)
    own = own.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    width = own.agg(F.max(F.size("x"))).first()[0] or 0

    def numbers(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.float64)  # nulls become NaN
            whole, sizes = np.floor(256 * values), np.diff(at)
            sound = np.abs(whole) <= LARGEST  # false for NaN
            bad = np.concatenate([[0], np.cumsum(~sound)])
            kept = bad[at[1:] - at[0]] == bad[at[:-1] - at[0]]
            out = np.zeros((batch.num_rows, width), "<i4")
            out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(at[:-1] - at[0], sizes)] = np.where(sound, whole, 0)
            vectors = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors], names=["vec_id", "label", "v"]).filter(pa.array(kept))

    rows = own.mapInArrow(numbers, "vec_id long, label long, v binary").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s"))
    return rows.select("vec_id", "s.label", "s.v"), width


def centroids_of(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k centroids of rows by Lloyd's passes from the first different rows; a cluster that loses all rows keeps its centroid."""
    _, first = np.unique(x, axis=0, return_index=True)
    c = x[np.sort(first)[:k]].astype(np.float64)
    for _ in range(PASSES):
        own = nearest(x, c)[0]
        counts = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, distance to it) of each row."""
    own = np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)
    return own, np.sqrt(((x - c[own]) ** 2).sum(axis=1))


@dataclass
class Index:
    """Centroids with radii and numbers of parts, and the lists: (cluster, part, ids, labels, vectors), a row for each part."""

    centroids: np.ndarray
    radii: np.ndarray
    parts: np.ndarray
    lists: DataFrame

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of rows x in each cluster, with room for what floating point loses."""
        own = np.sqrt((x * x).sum(axis=1))[:, None]
        middle, reach = x @ self.centroids.T, own * self.radii
        room = 1e-6 + 1e-9 * (own * np.sqrt((self.centroids**2).sum(axis=1)) + reach)
        return middle - reach - room, middle + reach + room


def _matrix(column, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def indexed(rows: DataFrame, n: int, width: int) -> Index:
    """The index of n rows (vec_id, label, v), all of them."""
    spark = rows.sparkSession
    k = min(MOST_CLUSTERS, max(1, round(math.sqrt(n) / 2)), max(1, CENTROID_BYTES // (8 * max(1, width))))
    sample = sample_by_hash(rows.select("vec_id", "v"), size_within(max(SAMPLE, k), n, n * 4 * width), n, key="vec_id").collect()
    centroids = centroids_of(np.frombuffer(b"".join(r["v"] for r in sample), "<i4").reshape(len(sample), width).astype(np.float64), k)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                own, far = nearest(_matrix(batch.column(2), "<i4", width).astype(np.float64), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], names=["vec_id", "label", "v", "cluster", "far"])

    assigned = stored(rows.mapInArrow(assign, "vec_id long, label long, v binary, cluster int, far double"), "assigned")
    radii, parts = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in assigned.groupBy("cluster").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # at most k rows
        radii[r["cluster"]], parts[r["cluster"]] = r["far"], -(-r["n"] // LIST)
    sizes = F.broadcast(spark.createDataFrame([(c, int(p)) for c, p in enumerate(parts)], "cluster int, parts long"))  # at most k rows
    dealt = assigned.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))

    def pack(table):
        import pyarrow as pa

        join = lambda c, dtype: table.column(c).to_numpy().astype(dtype).tobytes()
        row = [table.column("cluster")[0], table.column("part")[0], join("vec_id", "<i8"), join("label", "<i8"), b"".join(table.column("v").to_pylist())]
        return pa.table([pa.array([x.as_py() if hasattr(x, "as_py") else x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["cluster", "part", "ids", "labels", "vectors"])

    lists = stored(dealt.select("cluster", "part", "vec_id", "label", "v").groupBy("cluster", "part").applyInArrow(pack, "cluster int, part int, ids binary, labels binary, vectors binary"), "lists")
    discard(assigned)
    return Index(centroids, radii, parts, lists)


def window(goal: int | None) -> tuple[int, int]:
    """The scores that are at least LOW and at most HIGH percent of a goal; all of them without a goal."""
    return (NONE, -NONE - 1) if goal is None else (-(-LOW * goal // 100), HIGH * goal // 100)


def visits(index: Index, queries: DataFrame, first: int, last: int, width: int) -> DataFrame:
    """(cluster, part, block): which of the clusters from place `first` to before `last` of its order each query visits.

    queries: q, label, v, goals (a window each) and kth (the k-th score of each window, if it has so many).
    """
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radii, index.parts))

    def plan(batches):
        import pickle

        import pyarrow as pa

        own = Index(*shared.value, None)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                q, label, v, goals, kth = (block.column(block.schema.get_field_index(c)) for c in ("q", "label", "v", "goals", "kth"))
                x = _matrix(v, "<i4", width)
                windows = [[window(g) for g in of] for of in goals.to_pylist()]
                enough = [[NONE if s is None else s for s in of] for of in kth.to_pylist()]
                lower, upper = own.bounds(x.astype(np.float64))
                visit = np.zeros(upper.shape, bool)
                for i, of in enumerate(windows):
                    inside = np.zeros((len(of), upper.shape[1]), bool)
                    useful = inside.copy()
                    for j, (low, high) in enumerate(of):
                        inside[j] = (upper[i] >= low) & (lower[i] <= high) & (own.parts > 0)
                        useful[j] = inside[j] & (np.minimum(upper[i], float(high)) >= enough[i][j])
                    order = np.argsort(-upper[i], kind="stable")
                    order = order[inside.any(axis=0)[order]][first:last]
                    visit[i, order] = useful.any(axis=0)[order]
                q, label = q.to_numpy(), label.to_numpy()
                for c in np.flatnonzero(visit.any(axis=0)).tolist():
                    of = np.flatnonzero(visit[:, c])
                    data = pickle.dumps((q[of], label[of], x[of], [windows[i] for i in of], [enough[i] for i in of]))
                    n = int(own.parts[c])
                    yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([data] * n, pa.binary())], names=["cluster", "part", "block"])

    return queries.select("q", "label", "v", "goals", "kth").mapInArrow(plan, "cluster int, part int, block binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices, exactly: in floating point where no sum reaches 2**53."""
    if a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def scored(index: Index, planned: DataFrame, k: int, same: bool, width: int) -> DataFrame:
    """(q, w, id, score): for each visit and window the first k vectors of its part that may count: of the same label, without the query, or of others."""

    def score(batches):
        import pickle

        import pyarrow as pa

        for batch in batches:
            for data, ids, labels, vectors in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "ids", "labels", "vectors")), strict=True):
                q, label, x, windows, enough = pickle.loads(data)
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                scores = products(x, np.frombuffer(vectors, "<i4").reshape(len(ids), width))
                out = []
                for i in range(len(q)):
                    allowed = (labels == label[i]) & (ids != q[i]) if same else labels != label[i]
                    for w, (low, high) in enumerate(windows[i]):
                        at = np.flatnonzero(allowed & (scores[i] >= max(low, enough[i][w])) & (scores[i] <= high))
                        if len(at) > k:
                            at = at[scores[i, at] >= np.partition(scores[i, at], -k)[-k]]
                        at = at[np.lexsort((ids[at], -scores[i, at]))[:k]]
                        out.append((np.full(len(at), q[i]), np.full(len(at), w, np.int32), ids[at], scores[i, at]))
                if any(len(o[0]) for o in out):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["q", "w", "id", "score"])

    return planned.join(index.lists, ["cluster", "part"]).select("block", "ids", "labels", "vectors").mapInArrow(score, "q long, w int, id long, score long")


def searched(index: Index, queries: DataFrame, k: int, same: bool, width: int) -> DataFrame:
    """(q, w, place, id, score): the first k of each window of each query (q, label, v, goals), by descending score, then id."""
    by = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id")
    found, state = None, queries.withColumn("kth", F.transform("goals", lambda _: F.lit(None).cast("long")))
    first, last = 0, FIRST
    while first < len(index.centroids):
        planned = stored(visits(index, state, first, last, width), "visits")
        if not planned.isEmpty():
            new = scored(index, planned, k, same, width)
            before, found = found, stored((new if found is None else new.unionByName(found.drop("place"))).withColumn("place", F.row_number().over(by)).where(F.col("place") <= k), "found")
            if before is not None:
                discard(before)
            full = found.where(F.col("place") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("full"))  # a window each
            full = full.withColumnRenamed("q", "_q")
            state = queries.join(full, queries["q"] == full["_q"], "left").withColumn("kth", F.transform("goals", lambda _, w: F.try_element_at("full", w))).drop("_q", "full")
        discard(planned)
        first, last = last, last * GROWTH
    if found is None:
        return queries.sparkSession.createDataFrame([], "q long, w int, place int, id long, score long")
    return found


def hard_negatives(df: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    df: vec_id, label, embedding. Anchors are the vectors whose vec_id is divisible by `every`. Their positives are the
    first other vectors of the same label, and each positive has the first vectors of other labels whose score is LOW to
    HIGH percent of its own: fewer, or none, where there are no more. Scores are inner products of whole numbers;
    of equal ones the smaller vec_id comes first. Which rows take no part, and what repeats mean, is said in `whole_vectors`; shorter
    vectors are as if filled up with zeros. Other columns are ignored. An empty table, or one without anchors, gives no rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows, width = whole_vectors(df)
    rows = stored(rows, "vectors")
    n = rows.count()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], empty)
    index = indexed(rows, n, width)
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), "label", "v")
    one = F.array(F.lit(None).cast("long"))
    near = searched(index, anchors.withColumn("goals", one), positives, True, width)
    goals = near.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("goals"))  # at most `positives`
    asked = stored(anchors.join(goals, "q"), "asked")
    far = searched(index, asked, negatives, False, width)
    discard(rows, index.lists)
    pairs = near.select("q", (F.col("place") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score", "place": "rank"}).join(pairs, ["q", "w"])
    return found.select(F.col("q").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
