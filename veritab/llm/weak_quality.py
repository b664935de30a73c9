"""A quality classifier from weak labels.

Heuristic labellers vote on every document: 1 for natural text, 0 for junk, or they abstain.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeller is
and gives each pattern a posterior. A bounded sample with these soft labels trains a linear scorer
on hashed word shapes and statistics, which scores every document.

One pass reads the texts; its votes and sparse features are stored and serve the rest.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import bounded_batches, documents, own_columns, rows_of, stored
from veritab.llm.linear import Logistic, sample_by_hash, size_within
from veritab.llm.weak_labels import LabelModel

BITS = 14
#: Documents that train the scorer.
SAMPLE = 12_000
KEEP = 0.5
#: Share of junk assumed before anything is known.
PRIOR_GOOD = 0.8
#: Chances of a vote for natural text, for junk and natural text, from which the labellers start: each looks for one
#: kind of junk, so most of them miss most junk, but natural text is rarely called junk.
START = (0.6, 0.99)
LABELLERS = ("length", "symbols", "variety", "lines", "capitals", "word length", "bars", "endings", "echoes", "top word", "runs")
_SYMBOLS = re.compile(rb"[#*$%&|<>!]")
_RUNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
_CAPITALS, _SMALL = re.compile(rb"[A-Z]"), re.compile(rb"[a-z]")
_SHAPE = (re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+"))
MEMORY = 500_000


def statistics(data: bytes, words: list[bytes]) -> dict[str, float]:
    """Shares and sizes that labellers and features use; 0 where there is nothing to count."""
    n = len(words)
    letters = len(_SMALL.findall(data))
    capitals = len(_CAPITALS.findall(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return {
        "words": n,
        "symbols": len(_SYMBOLS.findall(data)) / max(1, n),
        # distinct words fall with length as the square root does, so they are compared with that
        "variety": len(set(words)) / max(1.0, min(n, 4 * n**0.5)),
        "repeated lines": 1 - len(set(lines)) / max(1, len(lines)),
        "capitals": capitals / max(1, letters + capitals),
        "word length": sum(map(len, words)) / max(1, n),
        "bars": words.count(b"|") / max(1, n),
        "endings": sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)),
        "lines": len(lines),
        "echoes": sum(map(operator.eq, words, words[1:])) / max(1, n),
        "runs": len(_RUNS.findall(data)) / max(1, n),
        "top word": max(Counter(words).values(), default=0) / max(1, n),
    }


def votes(s: dict[str, float]) -> list[int]:
    """What each labeller says: 1 good, 0 junk, -1 nothing."""
    between = lambda bad, good: 0 if bad else 1 if good else -1
    n = s["words"]
    return [
        between(n < 5, n >= 60),
        between(s["symbols"] > 0.3, s["symbols"] < 0.05),
        between(n >= 20 and s["variety"] < 0.3, n >= 20 and s["variety"] > 0.6),
        between(s["lines"] >= 4 and s["repeated lines"] > 0.3, s["lines"] >= 4 and s["repeated lines"] == 0),
        between(s["capitals"] > 0.4, s["capitals"] < 0.15),
        between(n > 0 and not 2.0 <= s["word length"] <= 14, 3.0 <= s["word length"] <= 9),
        between(s["bars"] > 0.1, -1 if n < 20 else s["bars"] == 0),
        between(s["lines"] >= 3 and s["endings"] < 0.2, s["endings"] > 0.6),
        between(n >= 20 and s["echoes"] > 0.1, n >= 20 and s["echoes"] < 0.02),
        between(n >= 20 and s["top word"] > 0.2, n >= 20 and s["top word"] < 0.12),
        between(s["runs"] > 0.15, s["runs"] < 0.03),
    ]


def _shape(word: bytes) -> bytes:
    for pattern, letter in zip(_SHAPE, (b"x", b"X", b"9"), strict=True):
        word = pattern.sub(letter, word)
    return word[:12]


def features(words: list[bytes], s: dict[str, float], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word shapes with damped shares, and hashed steps of the statistics."""
    if len(known) > MEMORY:
        known.clear()
    found = []
    for w in words:
        b = known.get(w)
        if b is None:
            b = known[w] = zlib.crc32(_shape(w)) * 2654435761 % (1 << 32) >> (32 - BITS)
        found.append(b)
    at, n = np.unique(np.array(found, np.int64), return_counts=True)
    value = np.log1p(100 * n / max(1, len(words))) / 5
    steps = [f"{k}:{round(8 * min(v, 4)) if k not in ('words', 'lines', 'word length') else round(2 * np.log2(1 + v))}" for k, v in s.items()]
    more = np.array([zlib.crc32(x.encode()) * 2654435761 % (1 << 32) >> (32 - BITS) for x in steps], np.int64)
    at, first = np.unique(np.concatenate([at, more]), return_index=True)
    return at, np.concatenate([value, np.ones(len(more))])[first]


def weighed(df: DataFrame) -> DataFrame:
    """(doc_id, votes, at, value): the votes of every document as one number in base 3, and its sparse features."""
    bounded_batches(df.sparkSession)

    def weigh(batches):
        import pyarrow as pa

        known: dict[bytes, int] = {}
        for ids, texts in rows_of(batches, "doc_id", "text"):
            codes, at, value = [], [], []
            for t in texts:
                data = (t or "").encode()
                words = data.split()
                s = statistics(data, words)
                codes.append(sum((v + 1) * 3**k for k, v in enumerate(votes(s))))
                a, x = features(words, s, known)
                at.append(a.astype("<u2").tobytes())
                value.append(x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.int32()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "votes", "at", "value"])

    return own_columns(df, "doc_id", "text").mapInArrow(weigh, "doc_id long, votes int, at binary, value binary")


def decode(codes: np.ndarray, labellers: int = len(LABELLERS)) -> np.ndarray:
    return np.asarray(codes, np.int64)[:, None] // 3 ** np.arange(labellers) % 3 - 1


def label_model(rows: DataFrame, labellers: int = len(LABELLERS), prior: float = PRIOR_GOOD, start: tuple[float, float] = START) -> tuple[LabelModel, dict[int, float], int]:
    """The model, the posterior of each pattern that occurs (at most 3 ** labellers), and the number of rows."""
    found = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    codes, n = np.array([r["votes"] for r in found], np.int64), np.array([r["n"] for r in found], np.float64)
    patterns = decode(codes, labellers)
    model = LabelModel().fit(patterns, n, prior=prior, start=start)
    return model, dict(zip(codes.tolist(), model.posterior(patterns).tolist(), strict=True)) if len(codes) else {}, int(n.sum())


def _sparse(at: bytes, value: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(value, "<f4").astype(np.float64)


def classified(df: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, n_votes, posterior, score, kept) of every row.

    posterior is the label model's, score the trained scorer's; kept is score >= keep. A null text counts
    as empty, on which nearly all labellers abstain or vote 0. A very long text is judged whole, by one vector of
    bounded size. Repeated rows each give a row; an empty table gives none.
    Columns other than doc_id and text are ignored.
    """
    rows = stored(weighed(df), "weak-quality")
    _, posterior, total = label_model(rows)
    total_bytes = rows.agg(F.sum(F.octet_length("at") + F.octet_length("value"))).first()[0] or 0
    sample = sample_by_hash(rows.where("doc_id is not null"), size_within(SAMPLE, total, total_bytes), total).select("votes", "at", "value", "doc_id").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["votes"]))
    scorer = Logistic(1 << BITS)
    if sample:
        scorer.fit([_sparse(r["at"], r["value"]) for r in sample], np.array([posterior[r["votes"]] for r in sample]))
    model = df.sparkSession.sparkContext.broadcast((scorer, posterior))

    def score(batches):
        import pyarrow as pa

        own, of = model.value
        for ids, codes, at, value in rows_of(batches, "doc_id", "votes", "at", "value"):
            scores = [float(own.shares(*_sparse(a, v))[0]) for a, v in zip(at, value, strict=True)]
            n = (decode(np.array(codes)) >= 0).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([of[c] for c in codes], pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "n_votes", "posterior", "score"])

    return rows.mapInArrow(score, "doc_id long, n_votes long, posterior double, score double").withColumn("kept", F.col("score") >= keep)


def op1_weak_quality(spark, sf_dir):
    return classified(documents(spark, sf_dir))
