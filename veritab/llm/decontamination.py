"""Benchmark decontamination.

The texts of a benchmark and of documents are lower-cased (A-Z) and cut into words: runs of ASCII letters and
digits and of all characters beyond ASCII. Ten words of an item in a row are a window; an item of fewer words,
but not none, is one window. Document words inside any occurrence of a window are hit.

The benchmark's words are numbered, and its windows become a hash set of 64-bit numbers, which is broadcast.
A document is looked up word by word first; only where as many known words follow one another as a window has
is a hash reckoned and looked up, and every hash found is verified on the numbers of the words, which are the
words themselves. So what is reported occurs, and nothing that occurs is missed.

A set is of bounded size. A benchmark that needs more is cut into pieces (overlapping, so that no window is
lost), dealt into blocks by hash, and documents meet one block after another; between blocks they are written
to the shared folder with what was found.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import bounded_batches, discard, documents, own_columns, rows_of, stored
from veritab.llm.shingles import mix

WINDOW = 10
#: Bytes of normalised benchmark text in one broadcast set, about: its arrays take some ten times as much.
BLOCK_BYTES = 4 << 20
#: Words of a piece of a benchmark text, before the words it shares with the next one.
PIECE = 2000
#: What stands for each byte. Letters are lower-cased, other ASCII characters but digits separate words.
_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def plain(text: str | None) -> bytes:
    """A text's UTF-8 bytes, lower-cased, with a space for every separator."""
    return (text or "").encode("utf-8", "replace").translate(_BYTES)


@dataclass
class Windows:
    """The windows of one block: word numbers, and by number of words the distinct windows, their hashes and their items."""

    numbers: dict[bytes, int]
    #: number of words -> (sorted hashes, distinct windows in the same order, where each one's items begin, items)
    by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    seed: int

    @staticmethod
    def of(pieces: list[tuple[int | None, bytes]], n: int) -> Windows:
        """pieces: item and normalised words; one of fewer than n words is a whole item."""
        words = [p.split() for _, p in pieces]
        numbers = {w: k for k, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(words)), 1)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for (item, _), own in zip(pieces, words, strict=True):
            if own:
                ids, width = np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)), min(n, len(own))
                found.setdefault(width, []).append((np.lib.stride_tricks.sliding_window_view(ids, width), -1 if item is None else item))
        seed = 0
        while True:
            by_width = {}
            for width, of in found.items():
                rows = np.concatenate([v for v, _ in of])
                items = np.repeat(np.array([i for _, i in of], np.int64), [len(v) for v, _ in of])
                distinct, inverse = np.unique(rows, axis=0, return_inverse=True)
                pairs = np.unique(np.stack([inverse.reshape(-1), items], axis=1), axis=0)
                hashes = hashed(distinct.T, seed)
                order = np.argsort(hashes)
                at = np.append(np.searchsorted(pairs[:, 0], np.arange(len(distinct))), len(pairs))
                parts = [pairs[at[k] : at[k + 1], 1] for k in order]
                by_width[width] = (hashes[order], distinct[order], np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.concatenate(parts))
            if all((np.diff(h) > 0).all() for h, *_ in by_width.values()):
                return Windows(numbers, by_width, seed)
            seed += 1  # two windows share a hash: a look-up would verify only one of them

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[int]]:
        """(number of words, spans of words that are hit, items with a window here) of a normalised text; -1 is an item without id."""
        words = text.split()
        ids = np.fromiter(map(self.numbers.get, words, itertools.repeat(0)), np.int32, len(words))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        starts, ends, items = [], [], []
        for width, (hashes, distinct, begin, of) in self.by_width.items():
            if len(ids) < width:
                continue
            at = np.flatnonzero(unknown[width:] == unknown[:-width])  # windows of known words only
            if not len(at):
                continue
            columns = ids[at + np.arange(width)[:, None]]
            where = np.searchsorted(hashes, own := hashed(columns, self.seed))
            where[where == len(hashes)] = 0
            hit = np.flatnonzero(hashes[where] == own)
            hit = hit[(distinct[where[hit]] == columns[:, hit].T).all(axis=1)]  # the words themselves
            starts.append(at[hit])
            ends.append(at[hit] + width)
            for k in np.unique(where[hit]):
                items.append(of[begin[k] : begin[k + 1]])
        if not any(len(s) for s in starts):
            return len(words), [], []
        return len(words), merged(np.concatenate(starts), np.concatenate(ends)), np.unique(np.concatenate(items)).tolist()


def hashed(columns: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each column's numbers, in their order."""
    out = np.full(columns.shape[1], seed, np.uint64)
    for row in columns:
        out = mix(out ^ row.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans that don't overlap or touch, ascending, with the same words."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    return list(zip(starts[first].tolist(), ends[np.append(np.flatnonzero(first)[1:] - 1, len(ends) - 1)].tolist(), strict=True))


def pieces_of(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, words): normalised texts cut into pieces of PIECE words that share n - 1 words with the next one; those without words left out."""

    def cut(batches):
        import pyarrow as pa

        for items, texts in rows_of(batches, "item_id", "text"):
            found = []
            for item, text in zip(items, texts, strict=True):
                words = plain(text).split()
                found += [(item, b" ".join(words[at : at + PIECE + n - 1])) for at in range(0, max(1, len(words) - n + 1), PIECE) if words]
            for at in range(0, len(found), 1000):
                part = found[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([w for _, w in part], pa.binary())], names=["item_id", "words"])

    return own_columns(benchmark, "item_id", "text").mapInArrow(cut, "item_id long, words binary")


def scanned(df: DataFrame, benchmark: DataFrame, n: int = WINDOW, texts: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with n_words, hits (spans of word numbers from 0, ends exclusive, that don't touch) and items (ascending item_ids with a window there).

    benchmark: item_id, text. A null text has no words; nor is a benchmark text without words any window. Repeated items count once;
    an item without id makes words hits but isn't listed. Words that several windows hit count once. An empty table gives no
    rows, an empty benchmark no hits. Texts are scanned whole, however long. Columns of df stay as they are; those named like
    the three new ones are replaced, and without `texts` the column text is left out.
    """
    bounded_batches(df.sparkSession)
    names = [c for c in df.columns if c not in ("n_words", "hits", "items")]
    rows = df.select(*[df[f"`{c}`"] for c in names], F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long>>").alias("hits"), F.array().cast("array<long>").alias("items"))
    pieces = stored(pieces_of(benchmark, n).distinct(), "benchmark")
    total = pieces.agg(F.sum(F.octet_length("words") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    before = None
    for k in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k)
        rows = _against(rows, Windows.of([(r["item_id"], bytes(r["words"])) for r in own.collect()], n), texts or k < blocks - 1)  # about block_bytes
        if k < blocks - 1:
            rows = stored(rows, "scanned")
            if before is not None:
                discard(before)
            before = rows
    discard(pieces)
    return rows


def _against(rows: DataFrame, windows: Windows, texts: bool) -> DataFrame:
    """rows with what the windows of one block add; without `texts` the column text ends here."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    schema = rows.schema if texts else rows.drop("text").schema
    kept = schema.names

    def scan(batches):
        import pyarrow as pa

        own = shared.value
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {name: batch.schema.get_field_index(name) for name in ("text", "hits", "items")}
            counts, hits, items = [], [], []
            for text, old_hits, old_items in zip(*(batch.column(k).to_pylist() for k in at.values()), strict=True):
                n, found, of = own.scan(plain(text))
                if found and old_hits:
                    both = np.array([*found, *((s["start"], s["end"]) for s in old_hits)], np.int64)
                    hits.append([{"start": a, "end": b} for a, b in merged(both[:, 0], both[:, 1])])
                else:
                    hits.append([{"start": a, "end": b} for a, b in found] or old_hits)
                items.append(sorted({*old_items, *(i for i in of if i >= 0)}) if of else old_items)
                counts.append(n)
            new = {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, spans), "items": pa.array(items, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(batch.schema.get_field_index(c)) for c in kept], names=kept)

    return rows.mapInArrow(scan, schema)


def without_spans(text: str | None, hits: list) -> str | None:
    """The text without the words of these spans and what stands between them."""
    if not text or not hits:
        return text
    data = text.encode("utf-8", "replace")
    of_word = np.frombuffer(b" " + data.translate(_BYTES) + b" ", np.uint8) != 0x20
    edges = np.flatnonzero(of_word[1:] != of_word[:-1]).reshape(-1, 2)  # where each word begins and ends
    out, at = [], 0
    for start, end in hits:
        out.append(data[at : edges[start, 0]])
        at = edges[end - 1, 1]
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def decontaminated(df: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WINDOW) -> DataFrame:
    """df without the documents that hold a window of the benchmark, or (remove="spans") with the hit words cut out of their texts.

    Nulls, repeats, ties, empty tables and long texts are as in `scanned`; all columns of df are kept, whatever else they are named, and
    n_chars, if there is one, is counted anew where a text was cut.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove documents or spans")
    names = df.columns
    own = df.select(*[df[f"`{c}`"].alias("text" if c == "text" else f"own_{k}") for k, c in enumerate(names)])
    found = scanned(own, benchmark, n)
    back = lambda rows: rows.select(*[F.col("text" if c == "text" else f"own_{k}").alias(c) for k, c in enumerate(names)])
    if remove == "documents":
        return back(found.where(F.size("hits") == 0))
    schema = found.schema

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                texts, hits = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "hits"))
                new = pa.array([without_spans(t, [(s["start"], s["end"]) for s in h]) for t, h in zip(texts, hits, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([new if f.name == "text" else batch.column(k) for k, f in enumerate(batch.schema)], names=batch.schema.names)

    rows = found.mapInArrow(cut, schema)
    if "n_chars" in names:
        count = f"own_{names.index('n_chars')}"
        rows = rows.withColumn(count, F.when(F.size("hits") > 0, F.char_length("text").cast(schema[count].dataType)).otherwise(F.col(count)))
    return back(rows)


def contamination(df: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row; nulls and the like as in `scanned`."""
    found = scanned(own_columns(df, "doc_id", "text"), benchmark, n, texts=False)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_decontamination(spark, sf_dir):
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
