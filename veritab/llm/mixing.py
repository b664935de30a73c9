"""Mixing with soft membership.

A classifier of words and of a text's form, trained on a labelled table, gives each document posteriors over domains. Nonnegative
rates of the documents are then fitted by least squares so that the expected tokens of each domain,
the sum of rate x tokens x posterior, match targets.

The fit is projected gradient descent in the metric where a document weighs as much as its tokens
and errors of the domains are weighed by the inverse of their Gram matrix over the documents whose
rate isn't zero; there the curvature is 1, which is the step, however rare or entangled domains are.
If targets are out of reach, that metric says little of what is near: then the fit starts again with
errors relative to the tokens that a domain has at first, and momentum, restarted where the error
grows, and ends at the nearest mix in that sense.

In both metrics documents of equal posteriors have equal rates at every step, so tokens are summed
by posteriors first (which are multiples of 1 / PARTS), and a pass covers these cells, of which there
are at most as many as lattice points, whatever the number of documents. A step needs only the weighed
residual of each domain, a few numbers; each pass replays the steps so far and sums the next residual,
so neither rates nor gradients are ever moved or kept.
"""

from __future__ import annotations

import functools
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm import tokens
from veritab.llm.common import bounded_batches, documents, few_or_many, own_columns, rows_of, stored
from veritab.llm.decontamination import plain
from veritab.llm.linear import Logistic, sample_by_hash, size_within

DOMAINS = ("clean", "toxic", "junk")
#: Shares of the tokens that the domains shall have, and the clean tokens kept, as a multiple of those there are.
TARGETS = {"clean": 0.97, "toxic": 0.01, "junk": 0.02}
CLEAN_FACTOR = 1.0
#: A feature is learned from if so many labelled documents of the sample have it and its chi-square for some domain is as high:
#: a few words tell a rare domain, and all the others would drown them.
LEAST_DOCUMENTS, LEAST_CHI = 3, 20.0
ROUNDS, L2 = 10, 1e-3
#: ASCII characters that are neither letters nor digits nor white space, and below which number forms lie.
MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
FORMS = 4096
#: Labelled documents that train the classifier.
SAMPLE = 6000
#: Posteriors are multiples of one part in so many.
PARTS = 1024
STEPS = 200
#: A target is met within this share of itself.
TOLERANCE = 1e-4
#: The fit has settled when its squared error hasn't fallen by this share within PATIENCE steps.
SETTLED = 1e-3
PATIENCE = 12
#: Domains whose target is below this share of all target tokens are measured against that share.
FLOOR = 1e-6


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain's number of a labelled row; null where it can't be told."""
    return F.when(toxic == 1, 1).when(quality == 0, 2).when((quality == 1) & (toxic == 0), 0)


def features(text: str | None) -> tuple[set[bytes], np.ndarray]:
    """What a whole text is told by: its distinct words, and its form as a few numbers below FORMS.

    Words are lower-cased and cut at ASCII characters other than letters and digits. The form is how often each other ASCII
    character occurs by words, how many words there are and how long they are, and what share of words and of lines is new, each in steps.
    """
    data = (text or "").encode("utf-8", "replace")
    own = plain(text)
    words = own.split()
    distinct, n = set(words), max(1, len(words))
    marks = np.bincount(np.frombuffer(data, np.uint8), minlength=128)[MARKS]
    seen = np.flatnonzero(marks)
    form = seen * 16 + np.minimum(15, np.log2(1 + 64 * marks[seen] / n)).astype(np.int64)
    lines = data.split(b"\n")
    steps = (16 * len(distinct) // n, n.bit_length(), 16 * len(set(lines)) // len(lines), min(31, (len(own) - own.count(b" ")) // n))
    return distinct, np.append(form, [1024 + 32 * k + x for k, x in enumerate(steps)])


@dataclass
class Domains:
    """A linear model of the words and forms that tell domains apart."""

    words: dict[bytes, int]
    #: The place of each form's weight, or of a weight of zero.
    forms: np.ndarray
    model: Logistic

    @staticmethod
    def of(rows: list[tuple[set[bytes], np.ndarray]], domains: np.ndarray) -> Domains:
        """Trained on the features and the domain of each row."""
        names: dict = {}
        own = [np.array([names.setdefault(x, len(names)) for x in (*sorted(w), *f.tolist())], np.int64) for w, f in rows]
        with_ = np.zeros((len(DOMAINS), len(names)))
        np.add.at(with_, (np.repeat(domains, [len(r) for r in own]), np.concatenate([*own, np.empty(0, np.int64)])), 1)
        total, of, n = with_.sum(axis=0), np.bincount(domains, minlength=len(DOMAINS))[:, None], max(1, len(rows))
        expected = total * of / n
        chi = (with_ - expected) ** 2 / np.maximum(expected * (1 - of / n) * (1 - total / n), 1e-9)
        chosen = np.flatnonzero((total >= LEAST_DOCUMENTS) & ((with_ > expected) & (chi >= LEAST_CHI)).any(axis=0))
        place = np.full(len(names) + 1, -1)
        place[chosen] = np.arange(len(chosen))
        model = Logistic(len(chosen) + 1, len(DOMAINS))  # the last weight stays zero
        if rows:
            model.fit([(x, np.ones(len(x))) for x in (place[r][place[r] >= 0] for r in own)], np.eye(len(DOMAINS))[domains], rounds=ROUNDS, l2=L2)
        forms = np.full(FORMS, len(chosen))
        taken = {name: int(place[k]) for name, k in names.items() if place[k] >= 0}
        for name, k in taken.items():
            if isinstance(name, int):
                forms[name] = k
        return Domains({name: k for name, k in taken.items() if isinstance(name, bytes)}, forms, model)

    @functools.cached_property
    def known(self) -> frozenset[bytes]:
        return frozenset(self.words)

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """The posteriors of several texts, a row each."""
        weights, sums = self.model.weights.T.copy(), np.tile(self.model.bias, (len(texts), 1))
        for k, text in enumerate(texts):
            words, form = features(text)
            own = [self.words[w] for w in self.known & words]
            sums[k] += weights[[*own, *self.forms[form].tolist()]].sum(axis=0)
        return self.model._shares(sums)


def domain_classifier(df: DataFrame, labels: DataFrame) -> Domains:
    """A classifier of domains from a bounded sample of labelled documents (labels: doc_id, domain).

    A doc_id whose labels contradict each other trains nothing. Of repeated documents one stands for all: the
    one with the smallest features.
    """
    bounded_batches(df.sparkSession)
    agreed = labels.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).where("domain = other").select("doc_id", "domain")
    chosen = F.broadcast(sample_by_hash(agreed, SAMPLE, agreed.count()))  # at most 2 * SAMPLE rows

    def featured(batches):
        import pyarrow as pa

        for ids, domains, texts in rows_of(batches, "doc_id", "domain", "text"):
            found = [features(t) for t in texts]
            words, forms = [b" ".join(sorted(w)) for w, _ in found], [f.astype("<u2").tobytes() for _, f in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(domains, pa.int32()), pa.array(words, pa.binary()), pa.array(forms, pa.binary())], names=["doc_id", "domain", "words", "forms"])

    rows = own_columns(df, "doc_id", "text").where("text is not null").join(chosen, "doc_id").select("doc_id", "domain", "text").mapInArrow(featured, "doc_id long, domain int, words binary, forms binary")
    rows = stored(rows.groupBy("doc_id", "domain").agg(F.min(F.struct("words", "forms")).alias("f")).select("doc_id", "domain", "f.words", "f.forms"), "features")
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("words") + F.octet_length("forms"))).first()
    rows = sample_by_hash(rows, size_within(2 * SAMPLE, n, total or 0), n).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["words"]))
    return Domains.of([(set(bytes(r["words"]).split()), np.frombuffer(r["forms"], "<u2")) for r in rows], np.array([r["domain"] for r in rows], np.int64))


def in_parts(p: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Posteriors, a row each, rounded to multiples of one part that still sum to 1: the largest one makes up for the others."""
    whole = np.rint(p * parts)
    whole[np.arange(len(p)), p.argmax(axis=1)] += parts - whole.sum(axis=1)
    return whole / parts


def memberships(df: DataFrame, model: Domains) -> DataFrame:
    """(doc_id, n_tokens, p): tokens of each whole text, as op4_token_counts has them, and the posteriors of its domains."""
    path = tokens.vocabulary_path()
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        import pyarrow as pa

        encoder, own = tokens.encoder(path), shared.value
        for ids, texts in rows_of(batches, "doc_id", "text"):
            found = [len(x) >> 2 for x in encoder.packed([t or "" for t in texts])]
            p = in_parts(own.shares(texts))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), lists], names=["doc_id", "n_tokens", "p"])

    return own_columns(df, "doc_id", "text").mapInArrow(judge, "doc_id long, n_tokens long, p array<double>")


@dataclass
class Steps:
    """The steps of a fit: the weighted residual of each, and how much of the change since the last step carries on."""

    residuals: list[np.ndarray] = field(default_factory=list)
    momentum: list[float] = field(default_factory=list)
    met: bool = False


def replay(p: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """(rates, point at which the next residual is taken) after these steps; p has a row for each document."""
    rate = point = np.ones(len(p))
    for r, m in zip(steps.residuals, steps.momentum, strict=True):
        new = np.maximum(0.0, point - p @ r)
        point = np.maximum(0.0, new + m * (new - rate))
        rate = new
    return rate, point


def _matrix(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def cells(rows: DataFrame) -> DataFrame:
    """(p, n_tokens) by equal posteriors: at most a row for each way to share out PARTS, whatever the input."""
    return stored(rows.groupBy("p").agg(F.sum(F.col("n_tokens").cast("double")).alias("n_tokens")), "cells")


def sums(rows: DataFrame, steps: Steps, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each domain at the rates after these steps, at the next point, Gram matrix of what isn't zero there).

    Each pass brings a few sums of each partition to an aggregate, one row to the driver.
    """

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((2 + n, n))
        for batch in batches:
            if batch.num_rows:
                p, n_tokens = _matrix(batch.column(1)), batch.column(0).to_numpy()
                rate, point = replay(p, steps)
                held = p[point > 0]
                total += np.concatenate([[(rate * n_tokens) @ p, (point * n_tokens) @ p], (held * n_tokens[point > 0, None]).T @ held])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.reshape(-1).tolist()], names=names)

    names = [f"s{k}" for k in range((2 + n) * n)]
    found = rows.select("n_tokens", "p").mapInArrow(partial, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    total = np.array([x or 0.0 for x in found]).reshape(2 + n, n)
    return total[0], total[1], total[2:]


def _descended(rows: DataFrame, targets: np.ndarray, gram: bool) -> tuple[Steps, np.ndarray]:
    """(steps, tokens reached): in the metric of the Gram matrix, or of the domains' first tokens with momentum."""
    n = len(targets)
    steps, errors, since, first = Steps(), [], 0, None
    unit = np.maximum(targets, max(1.0, FLOOR * targets.sum()))
    while True:
        got, point, own = sums(rows, steps, n)
        steps.met = bool((np.abs(got - targets) <= TOLERANCE * unit).all())
        first = got if first is None else first
        floor = 1e-9 * max(1.0, first.sum())
        metric = own + floor * np.eye(n) if gram else np.diag(np.maximum(first, floor))
        errors.append(float((got - targets) @ np.linalg.solve(metric, got - targets)))
        if steps.met or len(steps.residuals) >= STEPS or (len(errors) > PATIENCE and min(errors[-PATIENCE:]) > (1 - SETTLED) * min(errors[:-PATIENCE])):
            return steps, got
        since = since + 1 if len(errors) == 1 or errors[-1] <= errors[-2] else 0  # momentum that overshoots is dropped
        steps.residuals.append(np.linalg.solve(metric, point - targets))
        steps.momentum.append(0.0 if gram else since / (since + 3))


def fitted(rows: DataFrame, targets: np.ndarray) -> Steps:
    """The steps until each target is met within TOLERANCE of itself, or nothing changes any more.

    rows: n_tokens and p, stored. Targets may be out of reach; then the nearest mix is where steps no longer
    change it, met stays false, and a warning says how far off it is.
    """
    steps, got = _descended(rows, targets, gram=True)
    if not steps.met:
        steps, got = _descended(rows, targets, gram=False)
    if not steps.met:
        off = ", ".join(f"{x:+.2%}" for x in (got - targets) / np.maximum(targets, max(1.0, FLOOR * targets.sum())))
        warnings.warn(f"mixing targets not met after {len(steps.residuals)} steps, off by {off}", stacklevel=2)
    return steps


def target_tokens(rows: DataFrame, targets: dict[str, float] = TARGETS) -> np.ndarray:
    """Tokens for each domain, by shares, so that the first domain keeps CLEAN_FACTOR times its own."""
    own = rows.agg(F.sum(F.col("n_tokens") * F.col("p")[0])).first()[0] or 0.0
    return CLEAN_FACTOR * own / targets[DOMAINS[0]] * np.array([targets[d] for d in DOMAINS])


def copies(rate: Column, key: Column) -> Column:
    """How often a document is taken: its rate, rounded up or down by a hash of its key, so that the expectation is kept."""
    part = F.pmod(F.xxhash64(F.lit(23), key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(df: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, strict: bool = False) -> DataFrame:
    """(doc_id, n_tokens, p_clean, p_toxic, p_junk, rate, copies) of every row.

    labels: doc_id, quality, toxic. A null or empty text has no tokens: it bears on no target, and its rate
    is what its posteriors give. Without labels all domains are equally likely. A doc_id with labels that
    contradict each other trains nothing. Repeated rows each give a row, of equal rate and copies; an empty
    table gives none. Very long texts are one document of many tokens. Columns other than doc_id and text
    are ignored. Where the shares asked for can't be had, the nearest mix is returned and a warning says by how much each
    is missed; with `strict` that is an error. `shares` tells what was asked for and what is reached.
    """
    model = domain_classifier(df, labels.select("doc_id", domain_of(labels["quality"], labels["toxic"]).alias("domain")))
    rows = stored(memberships(df, model), "memberships")
    of = cells(rows)
    steps = fitted(of, target_tokens(of, targets))
    if strict and not steps.met:
        raise ValueError(f"no rates give the shares {targets}")

    def rates(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                p = _matrix(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(replay(p, steps)[0])], names=["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate"])

    found = rows.mapInArrow(rates, "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + ", rate double")
    return found.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def shares(rows: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(domain, requested, before, reached): shares of the expected tokens, from rows of `mixed`. A table without tokens has null shares."""
    of = lambda weight: [F.sum(weight * F.col(f"p_{d}")) for d in DOMAINS]
    before, reached = of(F.col("n_tokens")), of(F.col("n_tokens") * F.col("rate"))
    share = lambda own, k: F.try_divide(own[k], functools.reduce(lambda a, b: a + b, own))
    one = rows.agg(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(targets[d]).alias("requested"), share(before, k).alias("before"), share(reached, k).alias("reached")) for k, d in enumerate(DOMAINS)]).alias("s"))
    return one.select(F.inline("s"))


def resampled(df: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """df with every document as often as its rate says, all columns kept.

    Rows are matched by doc_id, null ids with each other; repeated rows of one doc_id are each taken equally
    often, as often as the most of them would be. An empty table gives no rows; null texts are taken at their rate.
    """
    found = mixed(df, labels, targets).groupBy("doc_id").agg(F.max("copies").alias("copies"))
    # most documents are taken once: only the others are looked up, so that texts needn't be moved while these are few
    others = few_or_many(stored(found.where("copies <> 1"), "copies"))
    rows = df.select(*[df[c].alias(f"own_{k}") for k, c in enumerate(df.columns)], df["doc_id"].alias("id")).join(others, F.col("id").eqNullSafe(F.col("doc_id")), "left").withColumn("copies", F.coalesce("copies", F.lit(1))).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(df.columns)])


def op9_mixing(spark, sf_dir):
    return mixed(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
