"""Packing documents into sequences by bin completion.

Documents become pieces of at most `size` tokens. Only how many pieces there are of each length
goes to the driver: at most `size` numbers, whatever the input. Bin completion works on these
counts: the largest length left opens a sequence, its undominated fillings are enumerated, least
waste first, and depth-first search over them is pruned by the waste that the best packing so far
allows. Best-fit gives the first incumbent, and each better packing found is the next one.

The search stops where the incumbent meets a lower bound, which proves it optimal. For up to EXACT
pieces it otherwise goes on until nothing is left to try, which proves it as well. For more pieces
a filling is first used as often as the counts let it, so that a plan has a few thousand patterns
even for billions of pieces, and after NODES steps the incumbent stands, whether it meets the bound
or not: the problem is NP-hard. No piece is ever left out.

The plan goes back as intervals of ranks: the pieces of one length are numbered in parallel,
and each interval says which sequences, at which offset, its ranks fill.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm import tokens
from veritab.llm.common import bounded_batches, documents, own_columns, rows_of, stored

SIZE = 4096
END = 1
#: Up to so many pieces the search has no limit.
EXACT = 30
#: Steps of the search over packings of more pieces.
NODES = 3000
#: Levels of the search whose enumeration is held; those further up start again when the search comes back to them.
HELD = 48
#: Pieces of one length are numbered in groups of about so many at most.
GROUP_ROWS = 100_000
GROUPS = 256

Pattern = tuple[tuple[int, int], ...]  # (length, how many), largest first


def _smear(bits: int, n: int) -> int:
    """The bits, each set also at the n places above it."""
    out, width = bits, 1
    while width <= n:
        step = min(width, n + 1 - width)
        out |= out << step
        width += step
    return out


def dominated(parts: Pattern, counts: dict[int, int], available: int, slack: int) -> bool:
    """Whether some of the parts could make way for one larger piece left over, or several for one of their total.

    What the swap sets free fits wherever that piece would have gone, so a packing with such a filling is never
    better than the one after the swap. available has a bit for each length of which there are pieces.
    """
    some, several, left = 0, 0, available  # sums of at least one, and of at least two of the parts
    for length, n in parts:
        for _ in range(n):
            several |= (some << length) | (several << length)
            some |= (some << length) | (1 << length)
        if counts[length] <= n:
            left &= ~(1 << length)
    return bool(several & left) or bool(slack and (_smear(some << 1, slack - 1) & left))


def fillings(lengths: list[int], counts: dict[int, int], rest: int, most_waste: int) -> Iterator[tuple[int, Pattern]]:
    """(waste, filling) of all undominated fillings of the rest of a sequence that waste no more than most_waste, least waste first.

    lengths is ascending. Of equal waste, those of larger pieces come first. Sums that the smaller
    lengths can reach are kept as bits, so no step of the enumeration leads nowhere.
    """
    usable = [x for x in lengths[: bisect.bisect_right(lengths, rest)] if counts[x] > 0]
    reach, full = [1], (1 << (rest + 1)) - 1
    for x in usable:
        bits, n, step = reach[-1], min(counts[x], rest // x), 1
        while n > 0:
            take = min(step, n)
            bits |= (bits << (take * x)) & full
            n, step = n - take, step * 2
        reach.append(bits)
    available = sum(1 << x for x in usable)

    def exact(left: int, at: int, parts: list[tuple[int, int]]) -> Iterator[Pattern]:
        if not left:
            yield tuple(parts)
            return
        at = min(at, bisect.bisect_right(usable, left))
        while at > 0 and reach[at] >> left & 1:
            length = usable[at - 1]
            for n in range(min(counts[length], left // length), 0, -1):
                if reach[at - 1] >> (left - n * length) & 1:
                    yield from exact(left - n * length, at - 1, [*parts, (length, n)])
            at -= 1

    for waste in range(min(most_waste, rest) + 1):
        if reach[-1] >> (rest - waste) & 1:
            for parts in exact(rest - waste, len(usable), []):
                if not _fits(parts, counts, usable, waste) and not dominated(parts, counts, available, waste):
                    yield waste, parts


def _fits(parts: Pattern, counts: dict[int, int], usable: list[int], slack: int) -> bool:
    """Whether a piece that the filling leaves over still fits into the slack."""
    used = dict(parts)
    return any(counts[x] > used.get(x, 0) for x in usable[: bisect.bisect_right(usable, slack)])


def lower_bound(counts: dict[int, int], size: int) -> int:
    """No packing has fewer sequences: by total length, or, for each k, by pieces of at least k, of which those above size - k stand alone."""
    lengths = sorted(x for x, n in counts.items() if n)
    if not lengths:
        return 0
    tokens_to, pieces_to = [0], [0]  # of the lengths before each place
    for x in lengths:
        tokens_to.append(tokens_to[-1] + x * counts[x])
        pieces_to.append(pieces_to[-1] + counts[x])
    best = -(-tokens_to[-1] // size)
    half = bisect.bisect_right(lengths, size // 2)
    for at in range(half + 1):  # pieces shorter than k are left out; at == half: only those above half a sequence count
        k = lengths[at] if at < half else size // 2 + 1
        alone = max(half, bisect.bisect_right(lengths, size - k))
        wide, wide_tokens = pieces_to[alone] - pieces_to[half], tokens_to[alone] - tokens_to[half]
        small = tokens_to[half] - tokens_to[at]
        best = max(best, pieces_to[-1] - pieces_to[half] + max(0, -(-(small - (wide * size - wide_tokens)) // size)))
    return best


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, Pattern]]:
    """The incumbent: the largest piece left with, again and again, the largest that fits."""
    counts, lengths, plan = dict(counts), sorted(counts), []
    while lengths:
        top = lengths[-1]
        parts, left, below = {top: 1}, size - top, len(lengths)
        while left > 0:
            at = min(bisect.bisect_right(lengths, left), below) - 1
            while at >= 0 and counts[lengths[at]] - parts.get(lengths[at], 0) <= 0:
                at -= 1
            if at < 0:
                break
            length = lengths[at]
            n = min(left // length, counts[length] - parts.get(length, 0))
            parts[length] = parts.get(length, 0) + n
            left -= n * length
            below = at
        pattern = tuple(sorted(parts.items(), reverse=True))
        times = min(counts[x] // n for x, n in pattern)
        plan.append((times, pattern))
        for x, n in pattern:
            counts[x] -= times * n
            if not counts[x]:
                lengths.pop(bisect.bisect_left(lengths, x))
    return plan


def _total(plan: list[tuple[int, Pattern]]) -> int:
    return sum(times for times, _ in plan)


def bin_completion(counts: dict[int, int], size: int = SIZE, nodes: int = NODES, exact: int = EXACT) -> list[tuple[int, Pattern]]:
    """(times, pattern) that use up all counts, in as few sequences as the search finds.

    Optimal where lower_bound is met, and for up to `exact` pieces always; never worse than best-fit.
    """
    counts = {x: n for x, n in counts.items() if n > 0}
    if not counts:
        return []
    assert max(counts) <= size and min(counts) > 0
    bound, best = lower_bound(counts, size), best_fit(counts, size)
    total = sum(x * n for x, n in counts.items())
    few = sum(counts.values()) <= exact
    left, lengths = dict(counts), sorted(counts)
    plan: list[tuple[int, Pattern]] = []
    used = 0
    seen: dict[tuple, int] = {}  # what was left at places searched already, and the fewest sequences used till there

    def allowed() -> int:
        """Waste that a packing better than the incumbent may still have."""
        return (_total(best) - 1) * size - total - (used * size - (total - sum(x * left[x] for x in lengths)))

    def options() -> Iterator[tuple[int, Pattern]]:
        """(times, pattern): what the largest piece left may share a sequence with, and how often."""
        top = lengths[-1]
        left[top] -= 1
        found = fillings(lengths, left, size - top, allowed())
        while True:
            # the counts are as they were when this place was reached, but for the piece that opens the sequence
            waste, parts = next(found, (0, None))
            left[top] += 1
            if parts is None or waste > allowed():
                return
            merged = dict(parts)
            merged[top] = merged.get(top, 0) + 1
            pattern = tuple(sorted(merged.items(), reverse=True))
            most = min(left[x] // n for x, n in pattern)
            for times in range(most, 0, -1) if few else {most: 0, 1: 0}:
                yield times, pattern
            left[top] -= 1

    def apply(times: int, pattern: Pattern) -> None:
        nonlocal used
        for x, n in pattern:
            left[x] -= times * n
            if not left[x]:
                lengths.pop(bisect.bisect_left(lengths, x))
        plan.append((times, pattern))
        used += times

    def undo() -> None:
        nonlocal used
        times, pattern = plan.pop()
        for x, n in pattern:
            if not left[x]:
                bisect.insort(lengths, x)
            left[x] += times * n
        used -= times

    stack: list[Iterator | None] = [options()] if _total(best) > bound else []
    taken = [0] * len(stack)  # choices tried at each level
    while stack and (few or nodes > 0):
        if stack[-1] is None:
            stack[-1] = options()
            for _ in range(taken[-1]):
                next(stack[-1], None)
        if len(stack) > HELD:
            stack[-1 - HELD] = None
        choice = next(stack[-1], None)
        taken[-1] += 1
        if choice is None:
            taken.pop()
            stack.pop()
            if plan:
                undo()
            continue
        nodes -= 1
        apply(*choice)
        if not lengths and used < _total(best):
            best = list(plan)
            if used == bound:
                break
        state = tuple((x, left[x]) for x in lengths) if few else ()
        if not lengths or allowed() < 0 or (few and (seen.get(state, used + 1) <= used or used + lower_bound({x: left[x] for x in lengths}, size) >= _total(best))):
            undo()
        else:
            if few:
                seen[state] = used
            stack.append(options())
            taken.append(0)
    return best


@dataclass
class Intervals:
    """By length: where each interval of ranks starts, its first sequence, pieces a sequence, offset of the first piece."""

    starts: dict[int, list[int]]
    first: dict[int, list[int]]
    each: dict[int, list[int]]
    offset: dict[int, list[int]]


def intervals(plan: list[tuple[int, Pattern]]) -> Intervals:
    out, sequence, seen = Intervals({}, {}, {}, {}), 0, {}
    for times, pattern in plan:
        offset = 0
        for length, n in pattern:
            at = seen.get(length, 0)
            for store, value in ((out.starts, at), (out.first, sequence), (out.each, n), (out.offset, offset)):
                store.setdefault(length, []).append(value)
            seen[length] = at + times * n
            offset += length * n
        sequence += times
    return out


def pieces(df: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its token ids, then END, cut only where longer than size."""
    path = path or tokens.vocabulary_path()
    bounded_batches(df.sparkSession)
    end = END.to_bytes(4, "little")

    def cut(batches):
        import zlib

        import pyarrow as pa

        encoder = tokens.encoder(path)
        for ids, texts in rows_of(batches, "doc_id", "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, packed in zip(ids, encoder.packed([t or "" for t in texts]), strict=True):
                packed += end
                for piece, at in enumerate(range(0, len(packed), 4 * size)):
                    part = packed[at : at + 4 * size]
                    for column, value in zip(out, (doc, piece, at >> 2, len(part) >> 2, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return own_columns(df, "doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(df: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null or empty text is END alone. Very long texts are cut into pieces. Repeated rows are packed one by one;
    rows without doc_id too. Pieces of equal length are interchangeable: which one takes which place is settled by
    a random number written with it.
    An empty table gives no pieces. Columns other than doc_id and text are ignored.
    """
    rows = stored(pieces(df, size, path).withColumn("_salt", F.floor(F.rand(7) * (1 << 30)).cast("long")), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    plan = rows.sparkSession.sparkContext.broadcast(intervals(bin_completion(counts, size)))
    # salted, so that neither the commonest length nor repeated rows make a large group
    rows = rows.withColumn("_group", (F.col("_salt") % max(GROUPS, -(-max(counts.values(), default=0) // GROUP_ROWS))).cast("int"))
    groups = stored(rows.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("n")), "groups")
    before = groups.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_group"]).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long"))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        known: dict[int, tuple] = {}
        p = plan.value
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            length, rank = column("length").to_numpy(), column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                if x not in known:
                    known[x] = tuple(np.array(s[x], np.int64) for s in (p.starts, p.first, p.each, p.offset))
                starts, first, each, base = known[x]
                of = np.flatnonzero(length == x)
                at = np.searchsorted(starts, rank[of], side="right") - 1
                nth = rank[of] - starts[at]
                sequence[of] = first[at] + nth // each[at]
                offset[of] = base[at] + nth % each[at] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark, sf_dir):
    return packed(documents(spark, sf_dir))
