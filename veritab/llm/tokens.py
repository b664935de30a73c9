"""Token counts and ids with a whole-token shortcut.

Offline, each vocabulary string that ends a word is encoded alone; those that come back as
their one id are proven whole. White-space-free chunks of a text that are in this set count
as one token each without any merging; only the rest goes through the library's merges, each
distinct chunk once per bounded memory of recent chunks.

Counting by chunk is exact because white space always ends a pre-token of this vocabulary and
is dropped, normalisation works within chunks (composition never crosses ASCII white space),
and the special strings hold no white space.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import bounded_batches, documents, own_columns, rows_of

VOCABULARY = "word_bpe_49k.json"
#: Chunks remembered by a worker; beyond it those merged so far are forgotten, and merged again when met.
MEMORY = 1_200_000
#: Longest chunk, in bytes, that is remembered.
REMEMBERED = 64
#: A chunk of letters and then these is two pre-tokens.
POINTS = b".,;:!?"
#: From here on composed and decomposed spellings exist, which lower-casing first could mix up.
COMPOSING = re.compile("[^\x00-˿]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def prove_whole(tokenizer) -> dict[bytes, int]:
    """Vocabulary strings (as UTF-8 bytes, without the mark of a word's end) that encode alone as their own id."""
    strings, ids = [], []
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if token.endswith("</w>") and (raw := _as_bytes(token[:-4])):
            try:
                strings.append(raw.decode())
                ids.append(number)
            except UnicodeDecodeError:
                continue
    proven = {}
    for text, number, got in zip(strings, ids, tokenizer.encode_batch(strings, add_special_tokens=False), strict=True):
        if got.ids == [number] and not re.search(r"[\x20\x09-\x0D]", text):
            proven[text.encode()] = number
    return proven


@functools.cache
def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _as_bytes(token: str) -> bytes | None:
    letters = _byte_letters()
    return bytes(letters[c] for c in token) if all(c in letters for c in token) else None


def _letters(body: bytes) -> bool:
    """Whether all are letters, none of them composing, and stay so in lower case, so that they make one pre-token.

    Dotted capital I doesn't: its lower case ends with a combining mark, which joins the punctuation behind it.
    """
    if body.isalpha():  # of ASCII only
        return True
    text = body.decode()
    return text.isalpha() and text.lower().isalpha() and not COMPOSING.search(text)


def _plain(chunk: bytes) -> bool:
    """Letters that the normaliser leaves alone."""
    if chunk.isalpha():
        return chunk.islower()
    text = chunk.decode()
    return text.isalpha() and text == text.lower() and not COMPOSING.search(text)


class Encoder:
    """Encodes whole texts of one worker; ids are kept as packed little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.whole = {text: number.to_bytes(4, "little") for text, number in prove_whole(self.tokenizer).items()}
        self.known = dict(self.whole)
        # the vocabulary's merges without normaliser and patterns, for words that these would leave as they are
        from tokenizers import Tokenizer, pre_tokenizers

        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = {b: c for c, b in _byte_letters().items()}
        self.table = {b: letters[b] for b in range(256) if b != 32}

    def _merge(self, order: list[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks that need merging: plain words by merges alone, the rest with all the library does before."""
        plain = [x for x in order if _plain(x)]
        other = list(set(order).difference(plain)) if len(plain) < len(order) else []
        out = {}
        for part in (plain[at : at + 20_000] for at in range(0, len(plain), 20_000)):
            joined = b" ".join(part).decode("latin-1").translate(self.table)
            self._split(out, part, self.merges.encode(joined, add_special_tokens=False))
        for part in (other[at : at + 20_000] for at in range(0, len(other), 20_000)):
            self._split(out, part, self.tokenizer.encode([x.decode() for x in part], is_pretokenized=True, add_special_tokens=False))
        return out

    @staticmethod
    def _split(out: dict[bytes, bytes], part: list[bytes], got) -> None:
        import numpy as np

        ids = np.asarray(got.ids, dtype="<u4")
        of = np.asarray(got.word_ids if len(ids) else [], dtype=np.int64)
        packed, last = ids.tobytes(), 0
        for chunk, end in zip(part, (np.searchsorted(of, np.arange(len(part)), side="right") * 4).tolist(), strict=True):
            out[chunk] = packed[last:end]
            last = end

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        get, parts, missing = self.known.get, [], {}
        for text in texts:
            data = text.encode()
            if "<|" not in text and not COMPOSING.search(text):
                data = data.lower()  # ASCII only, as the normaliser does later anyway
            chunks = data.split()
            own = list(map(get, chunks))
            if None in own:
                gaps = [i for i, x in enumerate(own) if x is None]
                for i in gaps:
                    missing[chunks[i]] = None
                parts.append((own, gaps, [chunks[i] for i in gaps]))
            else:
                parts.append((own, (), ()))
        self._resolve(missing)
        for own, gaps, chunks in parts:
            for i, chunk in zip(gaps, chunks, strict=True):
                own[i] = missing[chunk]
            yield b"".join(own)

    def _resolve(self, missing: dict[bytes, bytes | None]) -> None:
        """Fill in the ids of chunks that aren't known, and remember them."""
        known, tails, bodies = self.known, {}, {}
        for chunk in missing:
            if b"<|" in chunk:
                missing[chunk] = self._alone(chunk)
            elif chunk[-1] in POINTS and (body := chunk.rstrip(POINTS)) and body[-1] > 64 and _letters(body):
                tails[chunk] = (body, chunk[len(body) :])
                bodies.update(dict.fromkeys(tails[chunk]))
            else:
                bodies[chunk] = None
        for body in bodies:
            bodies[body] = known.get(body)
        bodies |= self._merge([x for x, ids in bodies.items() if ids is None])
        for chunk in missing:
            if chunk in tails:
                body, tail = tails[chunk]
                missing[chunk] = bodies[body] + bodies[tail]
            elif missing[chunk] is None:
                missing[chunk] = bodies[chunk]
        if len(known) + len(missing) + len(bodies) > MEMORY + len(self.whole):
            known.clear()
            known.update(self.whole)
        known.update((x, ids) for x, ids in bodies.items() if len(x) <= REMEMBERED)
        known.update((x, ids) for x, ids in missing.items() if len(x) <= REMEMBERED)

    def _alone(self, chunk: bytes) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process: proving takes longer than a small batch."""
    return Encoder(path)


def token_counts(df: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    A null text counts as empty: no bytes, no tokens. Repeated rows each give a row; an empty table
    gives none. Columns other than doc_id and text are ignored.
    """
    path = path or vocabulary_path()
    bounded_batches(df.sparkSession)

    def count(batches):
        import pyarrow as pa

        own = encoder(path)
        for ids, texts in rows_of(batches, "doc_id", "text"):
            texts = [t or "" for t in texts]
            n = [len(x) >> 2 for x in own.packed(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return own_columns(df, "doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))
