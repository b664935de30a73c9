"""Near duplicates by bottom-k sketches from one hash function.

1. Every text gives its set of five-word shingles, hashed once. The k smallest numbers are its
   sketch. Texts with equal sets are one class; from here on only classes count.
2. Two sets of Jaccard similarity t or more share at least m of their sketches' values (m is the
   lower end of a hypergeometric distribution with the chance MISS of being undercut; for sets
   within the sketch it is a certain bound). Ordering all values by how many sketches hold them,
   rare ones first, the first shared value lies within the first (size - m + 1) values of both,
   so only those enter the inverted lists, and common passages mostly don't.
3. Each list proposes one leading member with each other member. Union sketches estimate the
   similarity and drop hopeless pairs; the rest are verified on their full shingle sets.
4. Links join classes to components. Where other members of a list ended in different components,
   what lies outside the largest of them is compared with the list's members on full sets, block
   by block. So no link between different texts is lost to a list's length, and pairs are never
   listed: not within a large group of near copies, nor outside it.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm import shingles as S
from veritab.llm.common import bounded_batches, discard, documents, own_columns, rows_of, stored
from veritab.llm.components import connected_components

K = 64
PERCENT = 75
#: Chance that a pair at the threshold shares fewer sketch values than m.
MISS = 1e-9
#: Members of a block, when lists are compared block by block.
BLOCK = 128
#: Bits of the filter of documents whose texts are needed for verification: 32 MB, whatever the input.
FILTER_BITS = 1 << 28
#: With fewer bits for each of these documents the filter would let too many others through; then they are joined.
FILTER_SHARE = 8


def _lower_end(draws: int, total: int, good: int) -> int:
    """The largest c with P(fewer than c good ones in so many draws) <= MISS."""
    log_choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    below = 0.0
    for c in range(max(0, draws - (total - good)), min(draws, good) + 1):
        below += math.exp(log_choose(good, c) + log_choose(total - good, draws - c) - log_choose(total, draws))
        if below > MISS:
            return c
    return min(draws, good)


@functools.cache
def least_shared(k: int = K, percent: int = PERCENT) -> np.ndarray:
    """m by set size; the last entry holds for all larger sets."""
    top = 40 * k
    by_union = np.array([_lower_end(min(k, u), u, -(-percent * u // 100)) for u in range(top * 100 // percent + 2)])
    of = np.array([by_union[n : n * 100 // percent + 1].min() for n in range(top + 1)])
    of[-1] = min(of[-1], _lower_end(k, 10_000_000, percent * 100_000))
    return of


def sketches(df: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, same, sketch): same is equal for equal sets; null for texts without words."""
    bounded_batches(df.sparkSession)

    def sketch(batches):
        import hashlib

        import pyarrow as pa

        for ids, texts in rows_of(batches, "doc_id", "text"):
            sets = [S.shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "same", "sketch"],
            )

    return own_columns(df, "doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, same binary, sketch array<long>")


def inverted_lists(classes: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(value, rep, score): the members of each inverted list; values of one sketch alone are left out.

    score is high for sketches of values that many have, as an original has that others were copied from.
    """
    m = F.element_at(F.array(*[F.lit(int(x)) for x in least_shared(k, percent)]), (F.least(F.col("n"), F.lit(40 * k)) + 1).cast("int"))
    held = classes.select("rep", (F.size("sketch") - m + 1).alias("first"), F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    # written first, so that the join has two plain shuffles, of which adaptive execution can split what one value holds
    often = stored(held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    per = held.join(often, "value").groupBy("rep").agg(F.first("first").alias("first"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"))
    left = F.col("first") - (F.col("size") - F.size("vs"))  # values of df 1 come first
    score = F.aggregate("vs", F.lit(0).cast("long"), lambda a, v: a + v["df"])
    return per.where(left > 0).select("rep", score.alias("score"), F.explode(F.slice("vs", 1, left)).alias("v")).select(F.col("v.value").alias("value"), "rep", "score")


def _estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, k: int, percent: int, least: np.ndarray) -> int:
    """0: hopeless, 1: to be verified, 2: certainly linked, by the union of two sketches."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return 0
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    if n_a <= k and n_b <= k:
        common = int(twice.sum())
        return 2 if 100 * common >= percent * (n_a + n_b - common) else 0
    # the k smallest of the union; of two equal ones the second is marked
    distinct_before = np.arange(1, len(both)) - np.cumsum(twice)
    shared = int((twice & (distinct_before < k)).sum())
    return int(shared >= least[min(max(n_a, n_b), len(least) - 1)])


def estimated(pairs: DataFrame, classes: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(a, b, sure) of the pairs that the union sketches let through."""
    least = least_shared(k, percent)
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            n_a, n_b = column("n_a").to_pylist(), column("n_b").to_pylist()
            cut = lambda c: [c.values.to_numpy()[x:y].view(np.uint64) for x, y in zip(c.offsets[:-1].to_pylist(), c.offsets[1:].to_pylist(), strict=True)]
            s_a, s_b = cut(column("s_a")), cut(column("s_b"))
            got = np.array([_estimate(*x, k, percent, least) for x in zip(s_a, s_b, n_a, n_b, strict=True)])
            out = pa.RecordBatch.from_arrays([column("a"), column("b"), pa.array(got == 2)], names=["a", "b", "sure"])
            yield out.filter(pa.array(got > 0))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return joined.mapInArrow(judge, "a long, b long, sure boolean")


def needed_texts(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the documents in pairs, and maybe of few others.

    Found in one pass with a bit filter broadcast to all, whose size grows with the documents up to
    FILTER_BITS; beyond that by a join.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = own_columns(df, "doc_id", "text").where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    n = ids.count()
    if n * FILTER_SHARE > FILTER_BITS:
        return texts.join(ids, "id", "left_semi")
    size = min(FILTER_BITS, 1 << max(12, (n * 2 * FILTER_SHARE).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(size))
    bits = ids.select(place.alias("p")).select(F.expr("cast(shiftright(p, 5) as int)").alias("at"), F.expr("shiftleft(1L, cast(p % 32 as int))").alias("bit"))
    rows = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(size >> 5, np.uint32)
    table[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = df.sparkSession.sparkContext.broadcast(table)

    def chosen(batches):
        import pyarrow as pa

        for batch in batches:
            p = batch.column(batch.schema.get_field_index("place")).to_numpy()
            yield batch.filter(pa.array((shared.value[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) > 0)).select(["id", "text"])

    return texts.select("id", "text", place.alias("place")).mapInArrow(chosen, "id long, text string")


def verified(pairs: DataFrame, df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of those pairs that are links by their full shingle sets; pairs is (a, b, sure), written already."""
    bounded_batches(df.sparkSession)
    open_ = pairs.where("not sure").select("a", "b")
    texts = stored(needed_texts(df, open_), "texts")

    def judge(batches):
        import pyarrow as pa

        last, of_last = None, None
        for a, b, t_a, t_b in rows_of(batches, "a", "b", "t_a", "t_b"):
            ok = []
            for x, y in zip(t_a, t_b, strict=True):
                if of_last is None or x != last:
                    last, of_last = x, S.shingles(x)
                ok.append(S.linked(of_last, S.shingles(y), percent))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(mask), pa.array(b, pa.int64()).filter(mask)], names=["a", "b"])

    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    found = open_.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b").mapInArrow(judge, "a long, b long")
    links = stored(pairs.where("sure").select("a", "b").union(found), "verified")
    discard(texts)
    return links


def sketches_allow(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, k: int = K, percent: int = PERCENT) -> np.ndarray:
    """For sets at places `left` and `right`, whether sizes and the values that their sketches share allow a link.

    The chance of a wrong no is MISS, as in the lists: two sets at the threshold share least_shared values of their sketches.
    """
    least = least_shared(k, percent)
    n = np.array([len(x) for x in sets])
    small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    needed = least[np.minimum(large, len(least) - 1)]
    return (small > 0) & (100 * small >= percent * large) & (S.shared_matrix([x[:k] for x in sets], left, right) >= needed)


def remaining_links(lists: DataFrame, leaders: DataFrame, labels: DataFrame, df: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(a, b): links across components between members of a list neither of which led it.

    Lists whose largest component is the same one make up a family. What a family has outside that
    component is compared with all of it, block by block: the union of two sketches drops hopeless pairs,
    full sets decide on the rest. Each block passes on one link for two components at most, so a pair of
    components is done with at its first link.
    """
    of = lists.join(leaders.withColumnRenamed("a", "leader"), "value").where("rep <> leader")
    of = of.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", F.coalesce("label", "rep").alias("label"))
    of = stored(of, "list-members")
    counts = of.groupBy("value", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("value").agg(F.max(F.struct("n", "label"))["label"].alias("family"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    mixed = stored(mixed.select("value", "family"), "mixed")
    members = stored(of.join(mixed, "value").select("family", "rep", "label").distinct(), "families")
    if members.isEmpty():
        discard(of, mixed)
        return members.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    sizes = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all_blocks"), F.ceil(F.count_if(F.col("label") != F.col("family")) / BLOCK).cast("int").alias("rest_blocks"))
    rest = F.col("label") != F.col("family")
    own = lambda n: F.pmod(F.xxhash64("rep", "family"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = members.join(sizes, "family")
    as_all = rows.withColumn("j", own(F.col("all_blocks"))).withColumn("i", each("rest_blocks")).withColumn("alone", F.col("all_blocks") == 1).withColumn("rest", rest & F.col("alone"))
    as_rest = rows.where(rest & (F.col("all_blocks") > 1)).withColumn("i", own(F.col("rest_blocks"))).withColumn("j", each("all_blocks")).withColumn("alone", F.lit(False)).withColumn("rest", F.lit(True))
    rows = as_all.unionByName(as_rest).select("family", "i", "j", "alone", "rest", "rep", "label")
    # of repeated rows one stands for all
    texts = stored(needed_texts(df, members.select(F.col("rep").alias("a"), F.col("rep").alias("b"))).groupBy("id").agg(F.min("text").alias("text")), "texts")
    rows = rows.join(texts.withColumnRenamed("id", "rep"), "rep")

    def compare(table):
        import pyarrow as pa

        rest = np.array(table["rest"].to_pylist(), bool)
        reps, labels = np.array(table["rep"].to_pylist(), np.int64), np.array(table["label"].to_pylist(), np.int64)
        sets = [S.shingles(t) for t in table["text"].to_pylist()]
        # of a family of one block all rows are on both sides
        left, right = np.flatnonzero(rest), np.arange(len(rest)) if table["alone"][0].as_py() else np.flatnonzero(~rest)
        possible = sketches_allow(sets, left, right, k, percent) & (labels[left][:, None] != labels[right][None, :])
        found = {}
        for p, q in zip(*np.nonzero(possible), strict=True):
            x, y = left[p], right[q]
            parts = (min(labels[x], labels[y]), max(labels[x], labels[y]))
            if parts not in found and S.linked(sets[x], sets[y], percent):
                found[parts] = (min(reps[x], reps[y]), max(reps[x], reps[y]))
        return pa.table({"a": pa.array([a for a, _ in found.values()], pa.int64()), "b": pa.array([b for _, b in found.values()], pa.int64())})

    links = stored(rows.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long"), "more")
    discard(of, mixed, members, texts)
    return links


def near_duplicates(df: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    A null or blank text has no shingles and is linked with nothing. doc_id is taken to be unique;
    repeated rows give equal rows. A row without doc_id takes no part: its component_id is null and it
    is kept. An empty table gives none. Columns other than doc_id and text are ignored.
    """
    df = own_columns(df, "doc_id", "text")
    rows = stored(sketches(df, k), "sketches")
    classes = stored(
        rows.where("doc_id is not null and same is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes"
    )
    lists = stored(inverted_lists(classes, k, percent), "lists")
    leaders = lists.groupBy("value").agg(F.max(F.struct("score", (-F.col("rep")).alias("least"), "rep"))["rep"].alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("value", "a")
    leaders = stored(leaders, "leaders")
    first = lists.join(leaders, "value").where("rep <> a").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    pairs = stored(estimated(first, classes, k, percent), "estimated")
    links = verified(pairs, df, percent)
    discard(pairs)
    labels = connected_components(links)
    more = remaining_links(lists, leaders, labels, df, k, percent)
    if not more.isEmpty():
        labels = connected_components(links.union(more))
    discard(lists, leaders, links, more)
    top = classes.select("same", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("label", "rep").alias("label"))
    found = rows.select("doc_id", "n_shingles", "same").join(top, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_duplicates(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
