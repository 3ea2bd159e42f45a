"""Token-id files in canonical, length-limited Huffman code, with bit offsets of independent blocks."""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm import tokens
from hubflow.llm.packing import part_starts
from hubflow.llm.scratch import written

MAGIC = b"HFTK1\0\0\0"
HEADER = struct.Struct("<8sIIII")
LONGEST = 18
BLOCK = 1024
SEGMENT = 1_000_000
FILES = "part long, segment long, n_tokens long, load binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol (0: never used), the fewest in all with none over longest, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols need codes over {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    kinds, last = [], np.zeros(0, np.int64)
    for _ in range(longest):
        packages = last[: len(last) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaves, packages))
        order = np.argsort(both, kind="stable")
        kinds.append(order < len(leaves))
        last = both[order]
    bits, take = np.zeros(len(used), np.int64), 2 * len(used) - 2
    for leaf in reversed(kinds):
        n = int(leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[used] = bits
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: ascending by length, then by symbol."""
    out, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        code <<= size - before
        here = np.flatnonzero(lengths == size)
        out[here] = code + np.arange(len(here))
        code, before = code + len(here), size
    return out


def encode(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, and the bit offset of each block."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    shift = (64 - (at & 31) - size).astype(np.uint64)
    value, word = code[ids] << shift, at >> 5
    n = int(word[-1]) + 2 if len(ids) else 0
    # codes of one word have no bit in common, so their sum is exact
    words = np.bincount(word, (value >> np.uint64(32)).astype(float), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), n)
    return words.astype(np.uint32).astype(">u4").tobytes(), at[::BLOCK].astype("<u8")


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each LONGEST bits that can come next."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    repeat = 1 << (LONGEST - lengths[order].astype(np.int64))
    fill = (1 << LONGEST) - int(repeat.sum())
    return np.concatenate((np.repeat(order, repeat), np.zeros(fill, np.int64))).astype(np.uint32), np.concatenate((np.repeat(lengths[order], repeat), np.ones(fill, np.uint8))).astype(np.int64)


def decode(data: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """n ids: one table lookup for an id, in all blocks at once."""
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    peek = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    symbol, size = table
    out, at = np.zeros((BLOCK, len(offsets)), np.uint32), offsets.astype(np.int64)
    whole = n // BLOCK
    for i in range(min(BLOCK, n)):
        if i == n % BLOCK and whole < len(at):
            at = at[:whole]
        if not len(at):
            break
        next_bits = (peek[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - LONGEST)
        out[i, : len(at)] = symbol[next_bits]
        at = at + size[next_bits]
    return out.T.reshape(-1)[:n]


def segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> bytes:
    """One segment of a file: header, which documents, their ids' numbers, block offsets, bits."""
    bits, offsets = encode(ids, lengths, code)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join((HEADER.pack(MAGIC, len(doc_ids), len(ids), len(offsets), len(bits)), known.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), sizes.astype("<u4").tobytes(), offsets.tobytes(), bits))


def read_segment(load: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[list, np.ndarray, np.ndarray]:
    magic, docs, n, blocks, size = HEADER.unpack_from(load)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEADER.size
    known = np.frombuffer(load, np.uint8, docs, at)
    doc_ids = np.frombuffer(load, "<i8", docs, at := at + docs)
    sizes = np.frombuffer(load, "<u4", docs, at := at + 8 * docs)
    offsets = np.frombuffer(load, "<u8", blocks, at := at + 4 * docs)
    at += 8 * blocks
    ids = decode(load[at : at + size], offsets, n, table)
    return [x if ok else None for x, ok in zip(doc_ids.tolist(), known.tolist(), strict=True)], sizes.astype(np.int64), ids


def id_counts(rows: DataFrame, dtype: str) -> np.ndarray:
    """How often each id is in all rows; to the driver comes one row for each id of the vocabulary."""
    top = 1 << 8 * np.dtype(dtype).itemsize if np.dtype(dtype).itemsize == 2 else 1 << 20

    def count(batches):
        total = np.zeros(top, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["ids"].to_pylist()), dtype), minlength=top)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["id", "n"])

    out = np.zeros(top, np.int64)
    for r in rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def write_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Files of all docs' ids in ascending order of doc_id (nulls first), written in the shared folder and read back as rows of segments.

    Segment -1 of part -1 is the code book: the bits of each id. Null texts count as empty and have only end_id;
    repeated rows stand one after the other.
    """
    dtype = tokens.id_type(tokenizer)
    rows = written(tokens.tokenized(docs, tokenizer, end_id), "token-ids")
    lengths = code_lengths(id_counts(rows, dtype))
    book = tokens.sc_broadcast(docs, lengths)

    def write(batches):
        code, part, number = codes(book.value), TaskContext.get().partitionId(), 0
        doc_ids, loads, total = [], [], 0

        def done():
            sizes = np.array([len(x) for x in loads], np.int64) // np.dtype(dtype).itemsize
            load = segment(doc_ids, sizes, np.frombuffer(b"".join(loads), dtype), book.value, code)
            return pa.record_batch([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([load], pa.binary())], names=["part", "segment", "n_tokens", "load"])

        for batch in batches:
            for doc, load in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                doc_ids.append(doc)
                loads.append(load)
                total += len(load)
                if total >= SEGMENT * np.dtype(dtype).itemsize:
                    yield done()
                    doc_ids, loads, total, number = [], [], 0, number + 1
        if doc_ids:
            yield done()

    files = rows.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(write, FILES)
    head = docs.sparkSession.createDataFrame([(-1, -1, 0, bytearray(lengths.tobytes()))], FILES)
    return written(files.unionByName(head), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits), ids_crc32, of every document in the files."""
    (head,) = files.where("part = -1").select("load").collect()
    book = tokens.sc_broadcast(files, np.frombuffer(bytes(head.load), np.uint8))
    segments = files.where("part >= 0")
    # (part, segment) numbers the segments; their totals are one row a segment of a million ids
    starts = part_starts(segments.withColumn("part", F.struct("part", "segment")))

    def read(batches):
        table = decoding_table(book.value)
        for batch in batches:
            for first, load in zip(batch["part_start"].to_pylist(), batch["load"].to_pylist(), strict=True):
                doc_ids, sizes, ids = read_segment(load, table)
                ends = np.cumsum(sizes)
                pieces = [ids[e - n : e].astype("<u4").tobytes() for n, e in zip(sizes, ends, strict=True)]
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(pieces, pa.binary()), pa.array([zlib.crc32(x) for x in pieces], pa.int64())], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return segments.withColumn("part", F.struct("part", "segment")).join(starts, "part").select("part_start", "load").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def op7_huffman_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_files(write_files(docs, tokens.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")), 1)).drop("ids")
