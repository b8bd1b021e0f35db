"""What the operators of this subpackage share: the scratch folder, texts as bytes, shingles."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a dictionary, model or seed set that may be shipped to every executor; beyond it another way is taken.
BROADCAST_LIMIT = 64 << 20

_CACHE_LIMIT = 400_000
_K = np.uint64(0x9E3779B97F4A7C15)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session has no such setting, a temporary folder is used, on a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the scratch folder: its lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True where crc32(id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, kept for words that come again; the cache is emptied when it is full."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes] | list[str], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def gram_hashes(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, one for each start; of the whole sequence if it is shorter."""
    n = len(hashed)
    size = min(width, n)
    if not n:
        return hashed
    out = hashed[: n - size + 1].copy()
    for k in range(1, size):
        out *= _K
        out += hashed[k : n - size + 1 + k]
    return mix(out + np.uint64(size))


def shingle_set(text: bytes | None, width: int, cache: WordHashes) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes: A-Z in lower case, words between ASCII white space."""
    words = text.lower().split() if text else ()
    return np.unique(gram_hashes(word_hashes(words, cache), width)) if words else np.empty(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, m = matrix.shape
    return pa.ListArray.from_arrays(np.arange(0, n * m + 1, m or 1, dtype=np.int32)[: n + 1], pa.array(matrix.ravel()))
