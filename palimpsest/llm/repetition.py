"""Repetition inside a single document by compression bands.

zstandard ratios of the letters, over the whole document and over fixed chunks, place each
document in a band. `short` texts have no room for repetition. `incompressible` ones are
rejected: from FREE bytes on, a text of which zstandard makes hardly less than what the
frequencies of its bytes alone allow repeats nothing worth naming. `repetitive` ones (ratios
below limits for their length) and `suspect` ones (all others) are measured exactly.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 20  # letters of one repeated run
SHARE = 0.35  # share of repeated letters from which a document counts
CHUNK = 2048  # bytes of one chunk
FREE = 4096  # bytes below which no text is rejected: headers hide what repeats
GAIN = 0.97  # share of the bytes' entropy above which compression found no repetition
#: (bytes below, ratio of compressed to plain bytes below which a text repeats itself)
REPETITIVE = [(300, 0.45), (1000, 0.30), (4000, 0.22), (1 << 62, 0.15)]
_OTHER = regex.compile(r"[^\p{L}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    return _OTHER.sub("", text.lower()) if text else ""


def limit(n: int) -> float:
    return next(x for below, x in REPETITIVE if n < below)


def entropy(raw: bytes) -> float:
    """Bits a byte that the frequencies of the bytes need, as a share of 8."""
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = n[n > 0] / len(raw)
    return float(-(p * np.log2(p)).sum() / 8)


def _compressor(size: int):
    log = min(27, max(10, int(size).bit_length()))
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(6, window_log=log, write_content_size=False))


def ratios(seq: str) -> tuple[float, float, float]:
    """Compressed share of the whole sequence, the least of its chunks (the last may be shorter), and its bytes' entropy."""
    raw = seq.encode()
    if not raw:
        return 1.0, 1.0, 0.0
    c = _compressor(len(raw))
    whole = len(c.compress(raw)) / len(raw)
    parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)] if len(raw) > CHUNK else []
    return whole, min((len(c.compress(p)) / len(p) for p in parts), default=whole), entropy(raw)


def band(seq: str, whole: float, least: float, even: float) -> str:
    n = len(seq.encode())
    if len(seq) <= SPAN:
        return "short"
    if whole <= limit(n) or least <= limit(CHUNK):
        return "repetitive"
    return "incompressible" if n >= FREE and whole >= GAIN * even and least >= GAIN * even else "suspect"


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def repeated_share(seq: str) -> float:
    """Share of letters that lie in SPAN consecutive letters that began earlier; 0.0 for up to SPAN letters."""
    n = len(seq)
    if n <= SPAN:
        return 0.0
    x = np.frombuffer(seq.encode("utf-32-le"), np.uint32).astype(np.uint64)
    x = (x + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    with np.errstate(over="ignore"):
        power, inverse = _power(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power, dtype=np.uint64)])
        h = (sums[SPAN:] - sums[:-SPAN]) * inverse[: n - SPAN + 1]
    order = np.argsort(h, kind="stable")
    s = h[order]
    again = order[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0.0
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + SPAN, -1)
    return float((np.cumsum(edge)[:n] > 0).sum() / n)


def measure(text: str | None, every: bool = False) -> tuple[int, float, float, str, float | None]:
    seq = letters(text)
    whole, least, even = ratios(seq)
    b = band(seq, whole, least, even)
    return len(seq), whole, least, b, 0.0 if b == "short" else repeated_share(seq) if every or b != "incompressible" else None


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """n_letters, ratio, chunk_ratio, band and share of repeated letters for every row; no shuffle.

    Only letters count, in lower case, without everything between them. Null, empty and
    letterless texts are `short` with share 0; the share of an `incompressible` document is
    null unless ``every`` asks for it. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                got = [measure(t, every) for t in part.column(1).to_pylist()]
                cols = list(zip(*got)) if got else [()] * 5
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.float64()]
                yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "n_letters", "ratio", "chunk_ratio", "band", "share"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_letters bigint, ratio double, chunk_ratio double, band string, share double")
    return out.withColumnRenamed("id", id_col)


def repetitive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of documents of which at least SHARE of the letters are repeated."""
    return repetition(df, id_col, text_col).where(F.col("share") >= SHARE).select(id_col)
