"""Encoding with a public byte-level tokenizer by monoid tree reduction.

A text is halved down to leaves; leaves are encoded, and neighbours are joined by
encoding a window around their border again. The window grows on either side until it
starts and ends at a stable place: where a letter or digit is followed by a space, a line
feed or a mark, or a mark other than an apostrophe by a letter or digit. No piece of the
tokenizer's pattern crosses such a place and none looks behind it, so tokens outside the
window are those of the whole text. Where no such place exists the window is the whole
text of both halves. Decoding concatenates the bytes of halves up the same kind of tree.
"""

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 256  # characters of a leaf of the tree, and ids of a leaf when decoding
COUNT_LEAF = 4096  # the same where only the number of ids is wanted
VOCABULARY = "byte_bpe_50k.tiktoken"
_STABLE = re.compile(r"[^\W_](?=[ \n]|[^\w\s])|[^\w\s'](?=[^\W_])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The encoding and the byte length of each token, loaded once a process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def _left_edge(text: str, lo: int, mid: int) -> int:
    """The last stable place of text[lo:mid], found by looking ever further back; lo if there is none."""
    step = 64
    while True:
        at = max(lo, mid - step)
        hits = [m.start() + 1 for m in _STABLE.finditer(text, at, mid)]
        if hits:
            return hits[-1]
        if at == lo:
            return lo
        step *= 2


def _right_edge(text: str, mid: int, hi: int) -> int:
    m = _STABLE.search(text, mid, hi)
    return m.start() + 1 if m else hi


def _join(enc, lengths: np.ndarray, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
    a, b = _left_edge(text, lo, mid), _right_edge(text, mid, hi)
    drop, n = len(text[a:mid].encode()), len(left)
    while drop > 0:
        n -= 1
        drop -= lengths[left[n]]
    skip, m = len(text[mid:b].encode()), 0
    while skip > 0:
        skip -= lengths[right[m]]
        m += 1
    assert drop == 0 == skip, "a stable place lies inside a token"
    return left[:n] + enc.encode_ordinary(text[a:b]) + right[m:]


def encode(text: str, enc, lengths: np.ndarray, leaf: int = LEAF) -> list[int]:
    """Token ids of a whole text; strings of special tokens are ordinary text."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)

    def reduce(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return enc.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return _join(enc, lengths, text, lo, mid, hi, reduce(lo, mid), reduce(mid, hi))

    return reduce(0, len(text))


def decode(ids: list[int], enc, leaf: int = LEAF) -> str:
    """The text of token ids: bytes of halves, concatenated up the tree."""
    def reduce(lo: int, hi: int) -> bytes:
        if hi - lo <= leaf:
            return enc.decode_bytes(ids[lo:hi])
        mid = (lo + hi) // 2
        return reduce(lo, mid) + reduce(mid, hi)

    return reduce(0, len(ids)).decode(errors="replace")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids): token ids of every row's text, one output row per input row, no shuffle.

    Null and empty texts give an empty list. Repeated rows give repeated results, null ids
    stay null; other columns are not read. ``path`` is the vocabulary file, by default that
    of the installed public tokenizers.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = tokenizer(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = [encode(t, enc, lengths) if t else [] for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((t for x in ids for t in x), np.int32, int(offsets[-1]))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, text): the text of every row's token ids; null and empty lists give an empty text."""
    path = path or vocabulary_path()

    @F.pandas_udf("string")
    def run(ids):
        enc, _ = tokenizer(path)
        return ids.map(lambda x: "" if x is None else decode([int(i) for i in x], enc))

    return df.select(id_col, run(F.col(ids_col)).alias("text"))


def token_counts(df: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and n_tokens of every row; null and empty texts have 0 tokens."""
    path = path or vocabulary_path()

    @F.pandas_udf("bigint")
    def count(texts):
        enc, lengths = tokenizer(path)
        return texts.map(lambda t: len(encode(t, enc, lengths, COUNT_LEAF)) if t else 0).astype("int64")

    return df.select(*keep, count(F.col(text_col)).alias("n_tokens"))
