"""Packing by concatenating and cutting: prefix sums in two passes, then fixed windows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm import tokens
from hubflow.llm.memory import give_back
from hubflow.llm.scratch import written

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def part_starts(rows: DataFrame) -> DataFrame:
    """part, part_start: ids in all partitions before it. One row for each partition of a scan, so the single window is small."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096) -> DataFrame:
    """Sequences of length ids, cut from the ids of all docs in the order of the scan; only the last one is shorter.

    One row per piece of a document: doc_id, start (its document's ids before it), length, ids (packed), ids_crc32
    (of the ids as little-endian 32-bit values), doc_tokens (with end_id), sequence_id, offset (of the piece in its
    sequence). A piece that ends at its sequence's end and not at its document's is the boundary record: the next
    piece of that document goes on there. A null or empty text gives one piece of end_id. Repeated rows are packed
    each for itself. Null doc_ids stay null. An empty table gives no rows.
    """
    rows = written(tokens.tokenized(docs, tokenizer, end_id), "packing-ids")
    dtype = tokens.id_type(tokenizer)

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in ("doc", "start", "length", "ids", "crc", "total", "at")}
            at = (batch["start"].to_numpy() + batch["part_start"].to_numpy()).tolist()
            for doc, first, load in zip(batch["doc_id"].to_pylist(), at, batch["ids"].to_pylist(), strict=True):
                ids, begin = np.frombuffer(load, dtype), 0
                while begin < len(ids):
                    end = min(len(ids), begin + length - (first + begin) % length)
                    piece = ids[begin:end]
                    for k, v in zip(out, (doc, begin, end - begin, piece.tobytes(), zlib.crc32(piece.astype("<u4").tobytes()), len(ids), first + begin), strict=True):
                        out[k].append(v)
                    begin = end
            place = np.array(out["at"], np.int64)
            long = pa.int64()
            yield pa.record_batch([pa.array(out["doc"], long), pa.array(out["start"], long), pa.array(out["length"], long), pa.array(out["ids"], pa.binary()), pa.array(out["crc"], long), pa.array(out["total"], long), pa.array(place // length), pa.array(place % length)], names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            give_back()

    return rows.join(part_starts(rows), "part").select("doc_id", "ids", "start", "part_start").mapInArrow(cut, PIECES)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokens.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")), 2).drop("ids")
