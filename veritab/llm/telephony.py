"""Telephony audio columns: G.711 and IMA ADPCM in WAV containers, decoded to resampled PCM.

Mu-law and A-law codes expand through tables of 256 entries made from their rules. ADPCM blocks
are independent of each other, so numpy decodes one sample of all blocks of a batch of files at a
time. PCM is resampled by a windowed-sinc filter, in stretches of bounded length, and stored as
16-bit WAV.

A payload of bytes is stored as the codes of one of these formats: a byte is a sample of G.711, or
two of ADPCM, whose blocks each begin with a header of a first sample and a step.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from veritab.llm.common import bounded_batches, documents, own_columns, rows_of, stored

#: Format tags of WAV.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
RATE = 8000
TARGET_RATE = 16000
BLOCK_BYTES = 256
STRETCH = 1 << 20
UNIT = 64
#: Formats in which payloads are stored, chosen by their checksum: equal payloads are stored alike.
FORMATS = (MULAW, ALAW, ADPCM)
#: First sample and step index of each ADPCM block around a payload.
BLOCK_HEAD = struct.pack("<hBx", 0, 24)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law code: inverted bits, sign, exponent of 3 bits, mantissa of 4, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law code: even bits inverted, sign, exponent of 3 bits, mantissa of 4."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


@functools.cache
def tables() -> dict[int, np.ndarray]:
    return {MULAW: mulaw_table(), ALAW: alaw_table()}


@functools.cache
def nearest_code(tag: int) -> np.ndarray:
    """The code whose PCM is nearest, for each 16-bit sample (from -32768 on)."""
    table = tables()[tag].astype(np.int32)
    order = np.argsort(table, kind="stable")
    middle = (table[order][1:] + table[order][:-1]) / 2
    return order[np.searchsorted(middle, np.arange(-32768, 32768))].astype(np.uint8)


# Fixed values of IMA ADPCM.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEP_SIZES = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def _next(value: np.ndarray, index: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = STEP_SIZES[index]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
    return value, np.clip(index + INDEX_STEPS[code & 7], 0, len(STEP_SIZES) - 1)


def adpcm_decode(data: bytes, block: int = BLOCK_BYTES) -> np.ndarray:
    """PCM of mono blocks: a header of the first sample and step index, then two samples a byte, low half first.

    A last block that is cut short is decoded as far as it goes; a rest without a whole header is dropped.
    """
    return adpcm_decode_all([data], block)[0]


def adpcm_decode_all(files: list[bytes], block: int = BLOCK_BYTES) -> list[np.ndarray]:
    """PCM of the blocks of several files, one sample of all their blocks at a time."""
    if block < 4:
        raise ValueError("ADPCM blocks have a header of 4 bytes")
    ends = np.cumsum([-(-len(x) // block) for x in files])
    raw = np.zeros((int(ends[-1]) if len(ends) else 0, block), np.uint8)
    for x, end in zip(files, ends.tolist(), strict=True):
        own = raw[end - -(-len(x) // block) : end].reshape(-1)
        own[: len(x)] = np.frombuffer(x, np.uint8)
    index = np.minimum(raw[:, 2].astype(np.int32), len(STEP_SIZES) - 1)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    each = 1 + 2 * (block - 4)
    out = np.empty((each, len(raw)), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(raw[:, 4:].T)
    for at in range(len(codes)):
        for half, code in enumerate((codes[at] & 15, codes[at] >> 4)):
            value, index = _next(value, index, code)
            out[1 + 2 * at + half] = value
    pcm, found = out.T, []
    for x, end in zip(files, ends.tolist(), strict=True):
        over = len(x) % block
        samples = len(x) // block * each + (1 + 2 * (over - 4) if over >= 4 else 0)
        found.append(pcm[end - -(-len(x) // block) : end].reshape(-1)[:samples])
    return found


def adpcm_encode(pcm: np.ndarray, block: int = BLOCK_BYTES) -> bytes:
    """Blocks whose decoding follows the samples; the last one is padded with its last sample."""
    each = 1 + 2 * (block - 4)
    if not len(pcm):
        return b""
    rows = -(-len(pcm) // each)
    x = np.concatenate([pcm, np.repeat(pcm[-1:], rows * each - len(pcm))]).reshape(rows, each).astype(np.int32)
    out = np.zeros((rows, block), np.uint8)
    # each block starts with the step that suits its own slopes
    index = np.minimum(np.searchsorted(STEP_SIZES, np.abs(np.diff(x[:, :9], axis=1)).max(axis=1)), len(STEP_SIZES) - 1).astype(np.int32)
    value = x[:, 0]
    out[:, 2] = index
    out[:, :2] = value.astype("<i2")[:, None].view(np.uint8)
    for k in range(1, each):
        gap, step = x[:, k] - value, STEP_SIZES[index]
        code = np.where(gap < 0, 8, 0) | np.minimum(np.abs(gap) * 4 // step, 7)
        value, index = _next(value, index, code)
        out[:, 4 + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def wav(tag: int, data: bytes, rate: int = RATE, samples: int | None = None, block: int = BLOCK_BYTES) -> bytes:
    """A mono WAV file around stored samples."""
    bits, align, extra = {PCM: (16, 2, b""), ADPCM: (4, block, struct.pack("<HH", 2, 1 + 2 * (block - 4)))}.get(tag, (8, 1, b"\0\0"))
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * bits // 8, align, bits) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) if samples is None else samples)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(file: bytes) -> tuple[int, int, int, memoryview, int | None]:
    """(format tag, rate, block size, stored bytes, samples) of a mono WAV file; ValueError if it isn't one."""
    if len(file) < 12 or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate, align, samples = 12, None, 0, 1, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", file, at + 8)
            if channels != 1:
                raise ValueError("only mono is decoded")
        elif name == b"fact":
            samples = struct.unpack_from("<I", file, at + 8)[0]
        elif name == b"data":
            if tag is None or at + 8 + size > len(file):
                raise ValueError("broken WAV file")
            return tag, rate, align, memoryview(file)[at + 8 : at + 8 + size], samples
        at += 8 + size + size % 2
    raise ValueError("WAV file without data")


def framed(payload: bytes, tag: int, block: int = BLOCK_BYTES) -> bytes:
    """A WAV file whose codes are the payload: nothing is lost."""
    if tag != ADPCM:
        return wav(tag, payload)
    parts = [payload[at : at + block - 4] for at in range(0, len(payload), block - 4)]
    return wav(tag, b"".join(BLOCK_HEAD + x for x in parts), samples=len(parts) + 2 * len(payload), block=block)


def unframed(tag: int, data: memoryview | bytes, block: int) -> bytes:
    """The payload that was stored, from the codes of a WAV file."""
    if tag != ADPCM:
        return bytes(data)
    return b"".join(bytes(data[at + 4 : at + block]) for at in range(0, len(data), block))


def expand(tag: int, data: memoryview | bytes, block: int = BLOCK_BYTES) -> np.ndarray:
    """16-bit PCM of stored samples."""
    if tag in tables():
        return tables()[tag][np.frombuffer(data, np.uint8)]
    if tag == ADPCM:
        return adpcm_decode(bytes(data), block)
    if tag == PCM:
        return np.frombuffer(data, "<i2", len(data) // 2)
    raise ValueError(f"unknown WAV format {tag}")


@dataclass
class Audio:
    """A WAV file that was read: its format, rate, block size, codes and samples; or why it couldn't be."""

    tag: int = 0
    rate: int = 0
    block: int = 1
    data: memoryview | bytes = b""
    pcm: np.ndarray | None = None
    error: str | None = None


def read_all(files: list[bytes | None]) -> list[Audio]:
    """Several WAV files; ADPCM blocks of the same size are decoded together."""
    found, blocks = [], {}
    for file in files:
        try:
            tag, rate, block, data, samples = read_wav(file or b"")
            audio = Audio(tag, rate, block, data)
            if tag == ADPCM and block >= 4:
                blocks.setdefault(block, []).append((audio, samples))
            else:
                audio.pcm = expand(tag, data, block)
        except (ValueError, struct.error) as error:
            audio = Audio(error=str(error))
        found.append(audio)
    for block, of in blocks.items():
        for (audio, samples), pcm in zip(of, adpcm_decode_all([bytes(a.data) for a, _ in of], block), strict=True):
            audio.pcm = pcm[:samples]
    return found


@functools.cache
def _filter(up: int, down: int) -> np.ndarray:
    """A Hamming-windowed sinc, 8 zero crossings to each side, of `up` phases."""
    cut = max(up, down)
    x = np.arange(-8 * cut, 8 * cut + 1)
    taps = np.sinc(x / cut) * np.hamming(len(x)) / cut * up
    return taps.astype(np.float32)


def resampled(pcm: np.ndarray, rate: int, target: int = TARGET_RATE, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """The samples at the target rate, in stretches of bounded length. Beyond both ends is silence."""
    common = np.gcd(rate, target)
    up, down = int(target // common), int(rate // common)
    if up == down:
        yield from (pcm[at : at + stretch] for at in range(0, len(pcm), stretch))
        return
    taps = _filter(up, down)
    half = len(taps) // 2
    total = -(-len(pcm) * up // down)
    reach = half // up + 1
    for at in range(0, total, stretch):
        n = min(stretch, total - at)
        low = at * down // up - reach
        high = (at + n - 1) * down // up + reach + 1
        x = np.zeros(high - low, np.float32)
        x[max(0, -low) : max(0, -low) + len(pcm[max(0, low) : high])] = pcm[max(0, low) : high]
        out = np.empty(n, np.float32)
        for phase in range(up):  # outputs t with t * down = phase modulo up share their taps
            first = next((k for k in range(up) if (at + k) * down % up == phase), None)
            if first is None or first >= n:
                continue
            place = (at + np.arange(first, n, up)) * down // up - low
            own = taps[(half + phase) % up :: up]  # taps for x[place + reach'], going down
            offset = (half + phase) // up
            y = np.convolve(x, own)  # y[i] = sum over k of own[k] * x[i - k]
            out[first::up] = y[place + offset]
        yield np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def described(pcm: np.ndarray, rate: int, target: int = TARGET_RATE) -> tuple[bytes, str]:
    """(the resampled signal as a 16-bit WAV file, its features): samples, peak, mean square, zero crossings."""
    n = peak = square = crossings = 0
    last, parts = 0, []
    for x in resampled(pcm, rate, target):
        parts.append(x.astype("<i2").tobytes())
        n += len(x)
        wide = x.astype(np.int32)
        peak = max(peak, int(np.abs(wide).max(initial=0)))
        square += int(np.dot(x.astype(np.float64), x.astype(np.float64)))  # exact: below 2 ** 53
        sign = x >= 0
        crossings += int((sign[1:] != sign[:-1]).sum()) + int(last != 0 and len(sign) > 0 and (last > 0) != bool(sign[0]))
        last = 1 if len(sign) and sign[-1] else -1
    return wav(PCM, b"".join(parts), target), f"n={n};peak={peak};ms={square // n if n else 0};zc={crossings}"


def stored_audio(df: DataFrame, formats: tuple[int, ...] = FORMATS) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 of each text, padded with bytes 0, as the codes of a WAV file.

    A null text is stored as an empty one, which is padded as any other. Nothing is lost: the codes are the bytes.
    Equal texts give equal files, whatever else is in the row. Repeated rows each give a row, an empty table none;
    other columns are ignored. A very long text is one long file.
    """
    bounded_batches(df.sparkSession)

    def store(batches):
        import pyarrow as pa

        for ids, texts in rows_of(batches, "doc_id", "text"):
            raw = [(t or "").encode() for t in texts]
            whole = [x + b"\0" * (max(1, -(-len(x) // UNIT)) * UNIT - len(x)) for x in raw]
            media = [framed(x, formats[zlib.crc32(x) % len(formats)]) for x in whole]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return own_columns(df, "doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def decoded_audio(df: DataFrame, rate: int = TARGET_RATE) -> DataFrame:
    """(doc_id, pcm, error): WAV files of column media as 16-bit PCM WAV files at the rate, to be stored.

    A null or unreadable file gives a null pcm and says why in error. Repeated rows each give a row, an
    empty table none; other columns are ignored.
    """
    bounded_batches(df.sparkSession)

    def decode(batches):
        import pyarrow as pa

        for ids, files in rows_of(batches, "doc_id", "media"):
            found = read_all(files)
            pcm = [None if a.pcm is None else described(a.pcm, a.rate, rate)[0] for a in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pcm, pa.binary()), pa.array([a.error for a in found], pa.string())], names=["doc_id", "pcm", "error"])

    return own_columns(df, "doc_id", "media").mapInArrow(decode, "doc_id long, pcm binary, error string")


def audio_digests(df: DataFrame) -> DataFrame:
    """The digest columns of stored media (doc_id, n_bytes, media), from the stored bytes read back.

    feature, pcm_bytes and pcm_sha256 are of the file that decoded_audio gives. A null or unreadable file ends
    the job, as stored_audio writes none. Repeated rows each give a row, an empty table none; other columns
    are ignored.
    """
    bounded_batches(df.sparkSession)

    def digest(batches):
        import pyarrow as pa

        for ids, sizes, files in rows_of(batches, "doc_id", "n_bytes", "media"):
            out = []
            for file, audio in zip(files, read_all(files), strict=True):
                if audio.pcm is None:
                    raise ValueError(audio.error)
                payload = unframed(audio.tag, audio.data, audio.block)
                pcm, feature = described(audio.pcm, audio.rate)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature, audio.tag, len(pcm), hashlib.sha256(pcm).hexdigest()))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "format", "pcm_bytes", "pcm_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]], names=names)

    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, format int, pcm_bytes long, pcm_sha256 string"
    return own_columns(df, "doc_id", "n_bytes", "media").mapInArrow(digest, columns)


def op2_telephony_audio(spark, sf_dir):
    return audio_digests(stored(stored_audio(documents(spark, sf_dir)), "media"))
