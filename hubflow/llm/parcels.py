"""Documents dealt into chunks of bounded size, and arrays sent between chunks and hash buckets in packed form.

A chunk holds some MB of text. What a step has to say about single words or windows travels as one binary
value for each (chunk, bucket) instead of a row for each, already reduced to distinct values within the chunk:
a key that a third of all documents hold is sent once by a chunk, never once by a document.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4_000_000


#: Text of the chunks that one task holds, one after the other.
TASK_BYTES = 64_000_000


def deal(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """doc_id, text, row (its place), chunk and the columns keep (as keep0, keep1, ...) of docs, and the number of chunks; null texts count as empty.

    Rows are dealt by their place in the scan, so equal ones, of null ids and empty texts too, spread over all chunks, and
    a task that runs again after a lost executor deals alike: docs must come from files or a written table. The exchange
    has so many partitions that a task holds TASK_BYTES of text at any size.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)))
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, -(-(total or 0) // chunk_bytes), rows // 50_000)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TASK_BYTES))
    return docs.withColumn("chunk", chunk_of("row", n)).repartition(parts, "chunk"), n


def chunk_of(row: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(chunks))


def buckets(chunks: int) -> int:
    """Enough that a bucket holds what some 16 chunks send."""
    return max(12, chunks // 16)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, the first bytes of all values first, and so on: what varies little is compressed well."""
    parts = [len(arrays).to_bytes(1, "little")]
    for x in arrays:
        x = np.ascontiguousarray(x)
        parts += [x.dtype.str[1:].encode().ljust(2), len(x).to_bytes(4, "little"), x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 1
    for _ in range(data[0]):
        dtype, n = np.dtype(data[at : at + 2].decode().strip()), int.from_bytes(data[at + 2 : at + 6], "little")
        size = n * dtype.itemsize
        x = np.frombuffer(data, np.uint8, size, at + 6).reshape(dtype.itemsize, n) if n else np.zeros((dtype.itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(x.T).view(dtype).reshape(n))
        at += 6 + size
    return out


def bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n buckets begins and ends in sorted bucket numbers."""
    return np.searchsorted(keys, np.arange(n + 1))


def column(table: pa.Table, name: str) -> np.ndarray:
    """A column of integers without nulls."""
    return table[name].to_numpy()
