"""Mixing sources to target weights: how many copies of each document the mix takes, by subset-sum budget fitting."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
#: Words up and down from a first choice within which the dynamic program looks at every sum.
REACH = 1 << 22
#: Documents of a group that one task puts in order; larger groups are cut by their hash.
ORDERED = 1000


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """key, source_size, target, of a table (key, source, size, n) of how many documents of a source have a size.

    Sources in order of code points, null last, take weights in turn. Their targets are by weight, in all share times all
    words, none over most times its source's words: least(most x words, level x weight), with the one level at which
    they add up. One row a source goes through each window.
    """
    total = sizes.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    total = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    fullest = Window.orderBy(F.col("most") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(fullest), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fullest), F.lit(0.0)))
    return total.withColumn("level", level).withColumn("level", F.max("level").over(everything)).select("key", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def fit(size: np.ndarray, count: np.ndarray, budget: int, seed: int, reach: int = REACH) -> np.ndarray:
    """How many documents of each size, at most count, so that their sizes add up to budget or as near below as can be.

    Each size first gives the same share of its documents, then larger ones more while they fit; the knapsack then looks at
    all sums of documents given and taken back that stay within reach words (or twice the largest size) of that,
    and again from the best of them until none is nearer. Where all words are at most reach these are all sums there are, so no
    choice is nearer. Otherwise budget is hit unless sizes are large and few, and every such sum in reach is tried.
    """
    total = int((size * count).sum())
    if budget <= 0 or not total:
        return np.zeros(len(size), np.int64)
    if budget >= total:
        return count.copy()
    order = sorted(np.flatnonzero((size > 0) & (count > 0)).tolist(), key=lambda i: pd.util.hash_array(np.array([int(size[i]) * 1_000_003 + seed]))[0])
    take = np.array([int(n) * budget // total for n in count.tolist()], np.int64)
    rest = budget - int((size * take).sum())
    for i in np.argsort(-size, kind="stable").tolist():
        if size[i] > 0:
            k = min(int(count[i] - take[i]), rest // int(size[i]))
            take[i] += k
            rest -= k * int(size[i])
    width, step = min(total, max(reach, 2 * int(size.max()))), int(np.gcd.reduce(size[order]))
    while rest >= step:
        change = exchanged(size, count - take, take, order, rest // step * step, width)
        rest -= int((size * change).sum())
        if not change.any():
            break
        take += change
    return take


def exchanged(size: np.ndarray, free: np.ndarray, taken: np.ndarray, order: list[int], rest: int, width: int) -> np.ndarray:
    """The change of how many documents are taken, at most free more and taken less of each size, whose sum is nearest below rest (or rest), of all that stay within width on the way. Sums are bits of one number, width up and down from 0."""
    top, steps = width + min(rest, width), []
    first = np.full(2 * width + 1, -1, np.int32)  # the step by which a sum was reached
    sums, mask = 1 << width, (1 << 2 * width + 1) - 1
    moves = ((i, k) for i in order for left, sign in ((int(free[i]), 1), (int(taken[i]), -1)) for k in chunks(min(left, 2 * width // int(size[i])), sign))
    for i, k in moves:
        by = k * int(size[i])
        new = (sums << by if by > 0 else sums >> -by) & mask & ~sums
        if new:
            bits = np.frombuffer(new.to_bytes(width // 4 + 1, "little"), np.uint8)
            some = np.flatnonzero(bits)
            at = (some[:, None] * 8 + np.arange(8))[np.unpackbits(bits[some, None], axis=1, bitorder="little").astype(bool)]
            first[at] = len(steps)
            sums |= new
        steps.append((i, k))
        if sums >> top & 1:
            break
    out = np.zeros(len(size), np.int64)
    at = (sums & (1 << top + 1) - 1).bit_length() - 1
    while at != width:
        i, k = steps[first[at]]
        out[i] += k
        at -= k * int(size[i])
    return out


def chunks(n: int, sign: int):
    """1, 2, 4 and on, and what is left of n: sums of some of them are all numbers up to n."""
    k = 1
    while n:
        k = min(k, n)
        yield sign * k
        n, k = n - k, 2 * k


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (copies x size) and the columns keep, for each row of docs (doc_id, text, source).

    size counts the words of the text (null: 0). Every document of a source is taken floor(target / source_size) times;
    which of them once more, so that their sizes come to the target, goes by length and, among equal lengths, by a seeded
    hash of doc_id (of equal doc_ids any). Sizes of 0 are never taken once more. A null source is a source. An empty table
    gives no rows.
    """
    kept = [F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep) if c not in ("doc_id", "source")]
    back = [F.col(f"keep{i}").alias(c) for i, c in enumerate(keep) if c not in ("doc_id", "source")]
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    sized = written(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), size.alias("size"), *kept), "mixing-sizes")
    sizes = sized.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    goals = targets(sizes, weights, share, most)

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size").reset_index(drop=True)
        whole, target = int(part.source_size.iloc[0]), float(part.target.iloc[0])
        base = int(target // whole) if whole else 0
        part["base"] = base
        part["more"] = fit(part["size"].to_numpy(), part.n.to_numpy(), int(round(target - base * whole)), seed) if whole else 0
        return part[["key", "size", "n", "source_size", "target", "base", "more"]]

    # a source's rows here are its distinct sizes, however many documents it has
    plans = sizes.join(goals, "key").select("key", "size", "n", "source_size", "target").groupBy("key").applyInPandas(plan, "key string, size long, n long, source_size long, target double, base long, more long")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40))
    dealt = sized.join(plans, ["key", "size"]).withColumn("draw", draw).withColumn("cut", F.floor(F.col("draw") * F.ceil(F.col("n") / ORDERED) / (1 << 40)))
    before = Window.partitionBy("key", "size").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = dealt.groupBy("key", "size", "cut").count().select("key", "size", "cut", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "cut").orderBy("draw", "doc_id"))
    out = dealt.join(cuts, ["key", "size", "cut"]).withColumn("copies", F.col("base") + (F.col("before") + rank <= F.col("more")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["source"] if "source" in keep else []), *back)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")
