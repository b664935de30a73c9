"""Personal data: fixed patterns, and weak supervision for what they don't describe.

The base patterns (e-mail, IP address, card, phone) give exact spans. Beside them, tokens that
could be credentials or other identifiers are candidates. Labelers by regular expression, word
list and context vote on each candidate and on the base spans; expectation-maximisation over the
counts of vote patterns estimates their reliabilities, and a bounded sample with its posteriors
trains a span classifier on hashed features. Candidates that it accepts become spans of kind
`secret`; base spans always stay.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import bounded_batches, documents, own_columns, rows_of, stored
from veritab.llm.linear import Logistic, sample_by_hash
from veritab.llm.weak_quality import label_model

KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"
BITS = 12
SAMPLE = 20_000
ACCEPT = 0.5
#: Share of candidates assumed to be personal before anything is known.
PRIOR = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails at its start fails at all its places, so only starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")


def _emails(text: str) -> list[tuple[int, int]]:
    """As [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds them, from each @ outward."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; ends are exclusive, places are code points."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if len(m[0]) >= 16 else ""
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


#: Words that announce a credential, and words of ordinary numbers.
GAZETTEER = frozenset({"password", "passwd", "pwd", "pass", "token", "secret", "key", "apikey", "api_key", "credential", "auth", "bearer", "akia", "ssn", "iban"})
HARMLESS = frozenset({"version", "page", "section", "chapter", "license", "cc", "by-nc", "no", "table", "figure"})
# dots join the parts of web tokens, and = pads base64
_CANDIDATE = re.compile(r"(?<![^\s\"'`=:&,;|()\[\]{}<>])[A-Za-z0-9_+/-]{6,}(?:\.[A-Za-z0-9_+/-]+)*={0,2}(?![^\s\"'`&,;|.:!?()\[\]{}<>])")
_WORD = re.compile(r"[A-Za-z_-]+")
_KEY = re.compile(
    r"(?:AKIA[0-9A-Z]{16}|(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}|(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{16,}|[A-Za-z]{2,4}[-_](?=[A-Za-z]*[0-9])[0-9A-Za-z]{16,}"
    r"|eyJ[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]+){1,4}|(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{16,}={1,2})\Z"
)
_NATURAL = re.compile(r"(?:[A-Z]?[a-z-]+|[A-Z-]+)(?:\.(?:[A-Z]?[a-z-]+|[A-Z-]+))*\Z")
LABELERS = ("key pattern", "natural pattern", "word list", "assignment", "mixture", "length", "base pattern")


def candidate_votes(token: str, before: str, kind: str | None) -> list[int]:
    """What each labeler says of a token (1 personal, 0 not, -1 nothing); before is the text just before it."""
    words = [w.lower() for w in _WORD.findall(before[-24:])]
    digits, letters = sum(map(str.isdigit, token)), sum(map(str.isalpha, token))
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    near = words[-1:] and words[-1] in GAZETTEER or token[:4].lower() in GAZETTEER
    return [
        1 if _KEY.match(token) else 0,
        0 if _NATURAL.match(token) and not _KEY.match(token) else 1,
        1 if near else 0 if words[-1:] and words[-1] in HARMLESS else -1,
        1 if re.search(r"[=:]\s?[\"'`]?\Z", before) else 0,
        1 if changes >= 3 and letters else 0 if not digits else -1,
        1 if digits and len(token) >= 16 else 0 if len(token) < 10 else -1,
        1 if kind else 0,
    ]


def candidate_features(token: str, before: str) -> np.ndarray:
    """Hashed places of a token's shape, its three-letter shapes, the word before it and its size."""
    shape = re.sub(r"[a-z]", "x", re.sub(r"[A-Z]", "X", re.sub(r"[0-9]", "9", token)))
    words = _WORD.findall(before[-24:])
    names = {"b:" + (words[-1].lower() if words else ""), "e:" + before[-1:], f"n:{min(len(token), 40) // 4}", "p:" + token[:4], *("s:" + shape[i : i + 3] for i in range(min(len(shape), 60) - 2))}
    return np.unique([zlib.crc32(n.encode("utf-8", "replace")) * 2654435761 % (1 << 32) >> (32 - BITS) for n in names])


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and tokens that hold a digit or are long and aren't part of one: (kind or '', start, end).

    Tokens without a letter are no candidates: of mere digits the base patterns say which are personal. A token
    may hold a base span, as a key may hold the digits of a card.
    """
    found = list(base)
    taken = sorted((a, b) for _, a, b in base)
    k, end = 0, 0  # the farthest end of base spans that start no later than the token
    for m in _CANDIDATE.finditer(text):
        if (len(m[0]) < 14 and not _DIGIT.search(m[0])) or not _LETTER.search(m[0]):
            continue
        while k < len(taken) and taken[k][0] <= m.start():
            end = max(end, taken[k][1])
            k += 1
        if end < m.end():
            found.append(("", m.start(), m.end()))
    return found


_SPANS = "array<struct<kind:string,start:int,end:int,votes:int,at:binary>>"


def scanned(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and spans: base spans and candidates of every whole text, with votes and features."""
    bounded_batches(df.sparkSession)

    def scan(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32()), ("at", pa.binary())]))
        for ids, texts in rows_of(batches, "doc_id", "text"):
            out = []
            for text in texts:
                text, rows = text or "", []
                for what, a, b in candidates(text, base_spans(text)):
                    token, before = text[a:b], text[max(0, a - 32) : a]
                    code = sum((v + 1) * 3**j for j, v in enumerate(candidate_votes(token, before, what or None)))
                    rows.append({"kind": what, "start": a, "end": b, "votes": code, "at": candidate_features(token, before).astype("<u2").tobytes()})
                out.append(rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind)], names=["doc_id", "spans"])

    return own_columns(df, "doc_id", "text").mapInArrow(scan, f"doc_id long, spans {_SPANS}")


def span_model(rows: DataFrame) -> tuple[Logistic, dict[int, float]]:
    """The span classifier, and the posterior of each vote pattern."""
    each = rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.votes", "s.at")
    _, posterior, total = label_model(each, len(LABELERS), PRIOR, (0.2, 0.8))
    sample = sample_by_hash(each.withColumn("_key", F.struct("doc_id", "start")), SAMPLE, total, "_key").select("doc_id", "start", "votes", "at").collect()
    sample.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["votes"]))
    model = Logistic(1 << BITS)
    if sample:
        model.fit([_features(r["at"]) for r in sample], np.array([posterior[r["votes"]] for r in sample]))
    return model, posterior


def _features(at: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(at, "<u2").astype(np.int64)
    return at, np.full(len(at), 1 / max(1, len(at)) ** 0.5)


def personal_spans(df: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    spans is kind:start:end, comma-joined, by kind (added ones last), then start. A null text counts as
    empty and has no spans; very long texts are searched whole. Repeated rows each give a row; an empty table
    gives none. Columns other than doc_id and text are ignored.
    """
    rows = stored(scanned(df), "spans")
    model, _ = span_model(rows)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def decide(batches):
        import hashlib

        import pyarrow as pa

        own = shared.value
        for ids, spans in rows_of(batches, "doc_id", "spans"):
            out = []
            for of in spans:
                base = [f"{s['kind']}:{s['start']}:{s['end']}" for s in of if s["kind"]]
                n = [sum(s["kind"] == k for s in of) for k in KINDS]
                more = [f"{ADDED}:{s['start']}:{s['end']}" for s in of if not s["kind"] and own.shares(*_features(s["at"]))[0] >= accept]
                out.append((*n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base + more), len(more)))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return rows.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge under the first one's kind."""
    found = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    out, end = [], 0
    for a, b, kind in found:
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(df: DataFrame) -> DataFrame:
    """df with every text's personal data replaced, and n_chars, if there is one, counted anew.

    Spans of a row are found again while it is rewritten, from its own text, so nothing is joined and
    repeated doc_ids do no harm. A null text stays null, an empty one empty; very long ones are rewritten whole.
    An empty table gives no rows. All columns are kept; n_chars keeps its type.
    """
    rows = stored(scanned(df), "spans")
    model, _ = span_model(rows)
    shared = df.sparkSession.sparkContext.broadcast(model)
    bounded_batches(df.sparkSession)

    def rewrite(batches):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    found = candidates(text, base_spans(text))
                    spans = [f"{k}:{a}:{b}" for k, a, b in found if k]
                    spans += [f"{ADDED}:{a}:{b}" for k, a, b in found if not k and own.shares(*_features(candidate_features(text[a:b], text[max(0, a - 32) : a]).astype("<u2").tobytes()))[0] >= ACCEPT]
                    text = redacted(text, ",".join(spans)) if spans else text
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    done = df.mapInArrow(rewrite, df.schema)
    return done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else done


def op3_personal_data(spark, sf_dir):
    return personal_spans(documents(spark, sf_dir))
