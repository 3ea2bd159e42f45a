"""Quality classifier by compression with two zstandard dictionaries, one of good and one of bad labelled text."""

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.scratch import release, written
from hubflow.llm.tokens import sc_broadcast

#: Bounds of the sample that the classifier is fitted on: labelled documents of a class, and pieces of each that a dictionary may learn from.
SAMPLE, SAMPLE_PIECES = 1500, 8
DICT_BYTES = 112_640
#: Texts are compressed in pieces of so many bytes, so that the dictionary tells on long texts as on short ones.
PIECE = 2048
LEVEL = 3
#: Scores of at least so much are predicted good.
GOOD = 0.5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    #: Whether zstandard trained the good and the bad dictionary; where it had too little to, a dictionary is the sampled pieces themselves.
    trained: tuple[bool, bool] = (True, True)


def dictionary(pieces: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary and True; where pieces are too few to train one, their last DICT_BYTES bytes, which compress texts like them too, and False."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, k=200, d=8).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICT_BYTES:], False


class Differences:
    """(bytes with the bad dictionary - bytes with the good one) / the larger of both, over all pieces of a text; 0 for an empty text."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._ready(x), write_content_size=False, write_dict_id=False) for x in (good, bad)]

    @staticmethod
    def _ready(data: bytes) -> zstandard.ZstdCompressionDict:
        out = zstandard.ZstdCompressionDict(data)
        out.precompute_compress(level=LEVEL)
        return out

    def __call__(self, text: str) -> float:
        data = text.encode()
        good, bad = (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for c in self.by)
        return (bad - good) / max(good, bad, 1)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a slight pull to zero; classes weigh alike."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    scale = max(float(np.abs(x).mean()), 1e-9)
    a = np.column_stack((x / scale, np.ones(len(x))))
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (w * (y - p)) - 1e-2 * beta
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is kept from training; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled_pieces(texts: DataFrame, most: int) -> DataFrame:
    """doc_id, quality, piece: of each text at most so many pieces of PIECE bytes, dealt by hash over the whole text; of a short one all."""

    def cut(batches):
        for batch in batches:
            out = []
            for doc, quality, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "quality", "text")), strict=True):
                data = text.encode()
                places = sorted(range(0, len(data), PIECE), key=lambda i: zlib.crc32(f"{doc} {i}".encode()))[:most]
                out += [(doc, quality, i, data[i : i + PIECE]) for i in sorted(places)]
            doc, quality, place, piece = zip(*out, strict=True) if out else ((),) * 4
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(quality, pa.int32()), pa.array(place, pa.int64()), pa.array(piece, pa.binary())], names=["doc_id", "quality", "place", "piece"])

    return texts.mapInArrow(cut, "doc_id long, quality int, place long, piece binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pieces: int = SAMPLE_PIECES) -> Model:
    """Learn from at most so many documents of a class, dealt by a hash of doc_id; every second one calibrates only.

    Only labels of documents that are not held out count; where a document has several, the lowest, and where doc_id has
    several texts, the first in order. To the driver come at most so many pieces of each document that a dictionary
    learns from (2 x sample x pieces x 2 KB), and one number of each that calibrates, taken in a task from its whole text. Without labels of
    both classes every text gets 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rank = F.xxhash64(F.col("doc_id"), F.lit(10))
    parts = [known.where(F.col("quality") == q).orderBy(rank, "doc_id").limit(sample) for q in (0, 1)]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = found.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")  # at most 2 x sample rows
    texts = written(found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "labelled")
    ids = sorted(map(tuple, texts.select("quality", rank.alias("rank"), "doc_id").collect()))
    by = {q: [i for k, _, i in ids if k == q] for q in (0, 1)}
    learning = [i for q in (0, 1) for i in by[q][::2]]
    chosen = sorted(map(tuple, sampled_pieces(texts.where(F.col("doc_id").isin(learning)), pieces).select("quality", F.xxhash64("doc_id", F.lit(10)), "doc_id", "place", "piece").collect()))
    (good, trained_good), (bad, trained_bad) = (dictionary([bytes(p) for k, *_, p in chosen if k == q]) for q in (1, 0))
    model = Model(good, bad, 0.0, 0.0, (trained_good, trained_bad))
    if not by[0] or not by[1]:
        return model
    rest = sorted(map(tuple, differences(texts.where(~F.col("doc_id").isin(learning)), model).select("quality", "doc_id", "difference").collect()))
    slope, offset = calibrate(np.array([x for *_, x in rest]), np.array([q for q, *_ in rest], float))
    release(texts)
    return replace(model, slope=slope, offset=offset)


def differences(texts: DataFrame, model: Model, name: str = "difference") -> DataFrame:
    """texts with the difference of each whole text, null ones as empty, in a column of that name (one that is there already is replaced)."""
    shared = sc_broadcast(texts, model)
    fields = [f for f in texts.schema if f.name != name]
    names = [f"c{i}" for i in range(len(fields))]
    text = names[[f.name for f in fields].index("text")]

    def measure(batches):
        model = shared.value
        difference = Differences(model.good, model.bad)
        for batch in batches:
            x = pa.array([difference(t or "") for t in batch[text].to_pylist()], pa.float64())
            yield pa.record_batch([*(batch[c] for c in names), x], names=[*names, "x"])

    given = texts.select(*(F.col(f"`{f.name}`").alias(c) for f, c in zip(fields, names, strict=True)))
    out = given.mapInArrow(measure, given.select("*", F.lit(0.0).alias("x")).schema)
    return out.select(*(F.col(c).alias(f.name) for f, c in zip(fields, names, strict=True)), F.col("x").alias(name))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, from the text alone; null texts score as empty ones. Columns of docs keep their place, also one named score's (replaced)."""
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.slope * F.col("score") + model.offset))
    return differences(docs, model, "score").withColumn("score", 1 / (1 + F.exp(-x)))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
