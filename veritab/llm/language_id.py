"""Language identification by nearest centroid.

A text is lower-cased and its byte n-grams (1 to 3 bytes of UTF-8, so letters of any script) are
hashed into a vector of counts. Damped counts times inverse document frequency, scaled to length
1, are compared by cosine with several centroids of each language. Document frequencies come from
all training documents; centroids from a bounded sample of each language by spherical k-means, a
task for each language. Every language that occurs is learned; centroids are broadcast in blocks of
languages, and a document keeps the best cosine over all blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import bounded_batches, documents, own_columns, rows_of, stored

BITS = 12
SIZES = (1, 2, 3)
CENTROIDS = 6
ROUNDS = 8
#: Training documents a language gives to k-means, on average: all of them, or those with the smallest hashes.
SAMPLE = 400
#: Languages whose centroids are broadcast together: about 0.1 MB each.
BLOCK = 400
#: A document is rejected if its cosine to the nearest centroid is below the one that this share of the sample exceeds.
REJECT_SHARE = 0.005
STRETCH = 1 << 20
UNKNOWN = "und"
#: Letters, and numbers such as fractions and roman numerals, which aren't.
_LETTER_LIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether there is a letter, of Unicode's categories L, in the text."""
    return any(m[0].isalpha() for m in _LETTER_LIKE.finditer(text))


#: Bytes of letters stay; ASCII without letters, which says little of a language, becomes space, a run of which counts once.
_TO_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed n-gram counts of a whole text, taken in stretches of bounded length."""
    data = _TO_LETTERS[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    data = data[np.concatenate([[True], (data[1:] != 32) | (data[:-1] != 32)])]
    out = np.zeros(1 << bits, np.float64)
    shift = np.uint32(32 - bits)
    for at in range(0, len(data), STRETCH):
        part = data[at : at + STRETCH + max(SIZES) - 1].astype(np.uint32)
        own = min(STRETCH, len(data) - at)
        for n in SIZES:
            m = min(own, len(part) - n + 1)
            if m <= 0:
                continue
            number = part[:m].copy()
            for k in range(1, n):
                number |= part[k : k + m] << np.uint32(8 * k)
            number |= np.uint32(n << 24)
            out += np.bincount((number * np.uint32(2654435761)) >> shift, minlength=1 << bits)
    return out


def weights(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped TF-IDF scaled to length 1; zero stays zero."""
    x = np.log1p(count) * idf
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return (x / np.where(norm == 0, 1, norm)).astype(np.float32)


def frequencies(training: DataFrame, bits: int = BITS) -> tuple[np.ndarray, dict[str, int]]:
    """(how many training documents hold each n-gram bucket, how many there are of each language).

    Documents without a letter don't count. A row for each bucket and language comes to the driver.
    """

    def partial(batches):
        import pyarrow as pa

        total, of = np.zeros(1 << bits, np.int64), Counter()
        for texts, langs in rows_of(batches, "text", "lang"):
            for t, lang in zip(texts, langs, strict=True):
                if has_letter(t):
                    total += counts(t, bits) > 0
                    of[lang] += 1
        held = np.flatnonzero(total).tolist()
        if of:
            yield pa.RecordBatch.from_arrays([pa.array([*held, *[-1] * len(of)], pa.int32()), pa.array([*[None] * len(held), *of], pa.string()), pa.array([*total[held].tolist(), *of.values()], pa.int64())], names=["bucket", "lang", "n"])

    rows = training.select("text", "lang").mapInArrow(partial, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).collect()
    found = {r["bucket"]: r["n"] for r in rows if r["lang"] is None}
    return np.array([found.get(b, 0) for b in range(1 << bits)]), {r["lang"]: r["n"] for r in rows if r["lang"] is not None}


def centroids(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from spread-out first members: each next one is the vector least like those before."""
    first = [0]
    like = vectors @ vectors[0]
    while len(first) < min(k, len(vectors)):
        first.append(int(like.argmin()))
        like = np.maximum(like, vectors @ vectors[first[-1]])
    c = vectors[first]
    for _ in range(rounds):
        of = (vectors @ c.T).argmax(axis=1)
        c = np.stack([vectors[of == j].mean(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    """Centroids of some languages, the language of each, idf, and the cosine below which a language rejects."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    floor: dict[str, float]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected): score is the cosine, cut to 0 to 1; nothing without a letter has a language.

        Of equally near centroids the first one counts, languages being in alphabetical order.
        """
        open_ = [i for i, t in enumerate(texts) if t and has_letter(t)]
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        if not len(self.centroids):
            return out
        for at in range(0, len(open_), 256):
            part = open_[at : at + 256]
            like = weights(np.stack([counts(texts[i]) for i in part]), self.idf) @ self.centroids.T
            best = like.argmax(axis=1)
            for i, b, x in zip(part, best.tolist(), like[np.arange(len(part)), best].tolist(), strict=True):
                out[i] = (self.languages[b], min(1.0, max(0.0, x)), x < self.floor[self.languages[b]])
        return out


def learned(training: DataFrame) -> list[Model]:
    """Models of blocks of languages, in alphabetical order; training: doc_id, text and lang, none of the last two null.

    Of equal documents one is in the sample.
    """
    spark = training.sparkSession
    df, sizes = frequencies(training)
    if not sizes:
        return []
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1
    span = 1 << 40
    last = spark.createDataFrame([(x, int(min(1.0, SAMPLE / n) * span)) for x, n in sizes.items()], "lang string, last long")
    own = training.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(span))).join(F.broadcast(last), "lang").where("h <= last").select("lang", "h", "text")

    def vectors(batches):
        import pyarrow as pa

        for langs, hashes, texts in rows_of(batches, "lang", "h", "text"):
            rows = [(lang, h, counts(t).astype(np.int32).tobytes()) for lang, h, t in zip(langs, hashes, texts, strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["lang", "h", "counts"])

    def clustered(table):
        import pyarrow as pa

        table = table.sort_by("h")
        x = weights(np.stack([np.frombuffer(c, np.int32) for c in table["counts"].to_pylist()]).astype(np.float64), idf)
        c = centroids(x).astype(np.float32)
        floor = float(np.quantile((x @ c.T).max(axis=1), REJECT_SHARE))
        return pa.table({"lang": [table["lang"][0].as_py()] * len(c), "k": pa.array(range(len(c)), pa.int32()), "centroid": [row.tobytes() for row in c], "floor": [floor] * len(c)})

    sample = own.mapInArrow(vectors, "lang string, h long, counts binary").groupBy("lang", "h").agg(F.min("counts").alias("counts"))
    found = stored(sample.groupBy("lang").applyInArrow(clustered, "lang string, k int, centroid binary, floor double"), "centroids")
    names, models = sorted(sizes), []
    for at in range(0, len(names), BLOCK):
        part = names[at : at + BLOCK]
        rows = found.where(F.col("lang").between(part[0], part[-1])).collect() if len(names) > BLOCK else found.collect()
        rows.sort(key=lambda r: (r["lang"], r["k"]))
        if rows:
            models.append(Model(idf, [r["lang"] for r in rows], np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows]), {r["lang"]: r["floor"] for r in rows}))
    return models


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identified(df: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row by a model learned from training (doc_id, text, lang).

    A text that is null or has no letter gets `und` and score 0. A text far from all centroids is
    rejected, which is a mark beside the nearest language, not instead of it. Of equally near languages
    the first one in the alphabet counts. Without training rows all get `und`; an empty table gives no
    rows. Very long texts are taken whole, in stretches of bounded length. Repeated rows each give a row;
    other columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    models = learned(own_columns(training, "doc_id", "text", "lang").where("text is not null and lang is not null"))
    rows = own_columns(df, "doc_id", "text").select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    for at, model in enumerate(models):
        rows = _better(rows, spark.sparkContext.broadcast(model), last=at == len(models) - 1)
    return rows.drop("text")


def _better(rows: DataFrame, model, last: bool) -> DataFrame:
    """rows with the prediction of the model wherever that is nearer; the text is passed on unless it is the last one."""
    keep = "" if last else ", text string"

    def predict(batches):
        import pyarrow as pa

        for ids, texts, *before in rows_of(batches, "doc_id", "text", "lang_pred", "score", "rejected"):
            new = model.value.predict(texts)
            lang, score, rejected = zip(*[n if n[1] > old[1] or old[0] == UNKNOWN else old for n, old in zip(new, zip(*before, strict=True), strict=True)], strict=True)
            columns = [pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *([] if last else [pa.array(texts, pa.string())])], names=["doc_id", "lang_pred", "score", "rejected", *([] if last else ["text"])])

    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean" + keep)


def op10_language_id(spark, sf_dir):
    df = documents(spark, sf_dir)
    return identified(df, df.where(~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
