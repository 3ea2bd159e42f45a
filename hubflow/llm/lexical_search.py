"""Ranked lexical search turned round: documents stream through a broadcast inverted index over the items' terms."""

import math
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.memory import give_back
from hubflow.llm.scratch import release, written
from hubflow.llm.tokens import sc_broadcast
from hubflow.llm.words import text_bytes

#: Terms: runs of ASCII letters and digits and of all code points over 127; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
#: Bytes of text that are cut into terms at once.
PIECE = 1 << 20
#: Bytes of terms and postings of the items that one index holds, a broadcast; more items are searched in several passes.
INDEX_BYTES = 32 << 20
#: Scores, and parts of scores, that a task holds at once.
HELD = 1 << 20
#: Heaps of so many tasks' groups are merged before those of an item meet.
GROUPS = 1000
#: What each posting and each term of an index weighs besides the term's bytes.
POSTING = 24


def term_counts(data: bytes, known: dict | None = None) -> tuple[int, Counter]:
    """All terms of a text in UTF-8, with repeats; and how often each term occurs, or each value of known."""
    data, at, total, counts = data.translate(FOLD), 0, 0, Counter()
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        terms = data[at:end].split()
        total += len(terms)
        counts.update(terms if known is None else map(known.get, terms))
        at = end
    counts.pop(None, None)
    return total, counts


@dataclass(frozen=True)
class Index:
    """Postings of term t: items[first[t]:first[t + 1]] hold it so many times."""

    terms: dict[bytes, int]
    first: np.ndarray
    items: np.ndarray
    times: np.ndarray
    item_ids: list


def indexed(rows: list) -> Index:
    """The index over rows of item_id, terms, times."""
    terms: dict[bytes, int] = {}
    term = np.array([terms.setdefault(bytes(t), len(terms)) for r in rows for t in r.terms], np.int64)
    item = np.repeat(np.arange(len(rows)), np.array([len(r.terms) for r in rows], np.int64))
    times = np.array([n for r in rows for n in r.times], np.int64)
    order = np.argsort(term, kind="stable")
    return Index(terms, np.searchsorted(term[order], np.arange(len(terms) + 1)), item[order], times[order], [r.item_id for r in rows])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms, times and what they weigh in an index, of each distinct item that has terms."""

    def count(batches):
        for batch in batches:
            counts = [term_counts(x)[1] for x in batch["text"].to_pylist()]
            long = pa.int64()
            weight = [sum(len(t) + POSTING for t in c) for c in counts]
            yield pa.record_batch([batch["item_id"], pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(long)), pa.array(weight, long)], names=["item_id", "terms", "times", "weight"])

    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    return given.distinct().mapInArrow(count, "item_id long, terms array<binary>, times array<long>, weight long").where("weight > 0")


def blocks(rows: DataFrame, most: int) -> list[DataFrame]:
    """item_terms dealt into parts that weigh at most so much each, or are one item."""
    n = 1
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(n)))
        heaviest = dealt.groupBy("block").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).where(f"weight > {most} and n > 1").agg(F.max("weight")).first()[0]
        if heaviest is None:
            return [dealt.where(F.col("block") == i) for i in range(n)]
        n *= max(2, -(-heaviest // most))


def matched(docs: DataFrame, index) -> DataFrame:
    """doc_id, n (terms with repeats), terms (of the index, packed), times, of each document that has a term at all."""

    def match(batches):
        known = index.value.terms
        for batch in batches:
            found = [term_counts(x, known) for x in batch["text"].to_pylist()]
            n = np.array([x for x, _ in found], np.int64)
            pack = lambda values: pa.array([np.fromiter(v, "<u4").tobytes() for v in values], pa.binary())
            out = pa.record_batch([batch["doc_id"], pa.array(n), pack(c.keys() for _, c in found), pack(c.values() for _, c in found)], names=["doc_id", "n", "terms", "times"])
            yield out.filter(pa.array(n > 0))
            give_back()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return given.where("text is not null").mapInArrow(match, "doc_id long, n long, terms binary, times binary")


def statistics(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms of all documents, and in how many documents each of size terms occurs."""

    def count(batches):
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            total[:size] += np.bincount(text_bytes(batch["terms"])[0].view("<u4"), minlength=size)
            total[size:] += batch.num_rows, int(batch["n"].to_numpy().sum())
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(size + 2, np.int64)
    for r in found.select("n", "terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n  # one row for each term of the index
    return int(out[size]), int(out[size + 1]), out[:size]


def exact_sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit integers by place, in two halves of which floating point holds every sum."""
    low, high = values & 0x3FFFFFF, values >> 26
    return (np.bincount(at, high, size).astype(np.int64) << 26) + np.bincount(at, low, size).astype(np.int64)


class Heaps:
    """The k best documents of each item: by score, then by doc_id, null last."""

    def __init__(self, index: Index, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.index, self.weights, self.n_docs, self.n_terms, self.k = index, weights, n_docs, n_terms, k
        self.best = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, whether the doc_id is null, doc_id
        self.floor = np.ones(len(index.item_ids), np.int64)  # scores that may still come in

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of each document, in whole numbers, whatever their size."""
        if 75 * int(n.max(initial=0)) * self.n_docs < 1 << 63:
            return 25 + 75 * n * self.n_docs // self.n_terms
        return np.array([25 + 75 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)

    def add(self, doc_id: np.ndarray, null: np.ndarray, n: np.ndarray, first: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        """Documents whose terms are term[first[d]:first[d + 1]], in runs of at most HELD scores and postings."""
        postings = np.concatenate(([0], np.cumsum((self.index.first[1:] - self.index.first[:-1])[term])))
        ends, begin, items = postings[first], 0, len(self.floor)
        while begin < len(n):
            end = int(np.searchsorted(ends, ends[begin] + HELD, "right")) - 1
            end = max(begin + 1, min(end, begin + HELD // items, len(n)))
            here = slice(first[begin], first[end])
            self._run(doc_id[begin:end], null[begin:end], self.lengths(n[begin:end]), np.diff(first[begin : end + 1]), term[here], times[here])
            begin = end

    def _run(self, doc_id, null, m, sizes, term, times) -> None:
        doc = np.repeat(np.arange(len(m)), sizes)
        value = self.weights[term] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
        low = self.index.first[term]
        count = self.index.first[term + 1] - low
        place = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        at = np.repeat(doc, count) * len(self.floor) + self.index.items[place]
        scores = exact_sums(at, np.repeat(value, count) * self.index.times[place], len(m) * len(self.floor)).reshape(len(m), -1)
        floor = self.floor
        if len(m) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(m) - self.k, axis=0)[len(m) - self.k])
        row, item = np.nonzero(scores >= floor)
        new = item, scores[row, item], null[row].astype(np.int64), doc_id[row]
        item, score, none, doc = (np.concatenate(x) for x in zip(self.best, new, strict=True))
        order = np.lexsort((doc, none, -score, item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        kept = order[rank < self.k]
        self.best = [item[kept], score[kept], none[kept], doc[kept]]
        full = order[rank == self.k - 1]
        self.floor[item[full]] = score[full]


def search(docs: DataFrame, items: DataFrame, k: int = 10, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents with the highest scores above 0.

    The items' terms become an inverted index of at most index_bytes, which is broadcast; items beyond it go into further
    indexes, for which the documents are read again. Each document's counts of these terms are taken once from its whole
    text and written; N, L and df are counted over all of them. Every task then streams its documents through the index
    and keeps k of them for each item; heaps are merged in GROUPS groups of tasks, then for each item.

    Null texts are no documents and no items' texts, as are texts without a term. Each row is a document of its own, so a
    row that is repeated is found as often; equal rows of items count once, and items with the same item_id and other
    texts are ranked each for itself. Null doc_ids come last among equal scores. Long texts are cut into terms piece by
    piece. Other columns are ignored. Without items or documents there are no rows.
    """
    rows = written(item_terms(items), "search-items")
    out = [_searched(docs, part, k) for part in blocks(rows, index_bytes)]
    release(rows)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def _searched(docs: DataFrame, part: DataFrame, k: int) -> DataFrame:
    index = indexed(part.select("item_id", "terms", "times").collect())  # at most index_bytes
    shared = sc_broadcast(docs, index)
    found = written(matched(docs, shared), "search-terms")
    n_docs, n_terms, df = statistics(found, len(index.terms))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def best(batches):
        index = shared.value
        heaps, group = Heaps(index, weights, n_docs, n_terms, k), TaskContext.get().partitionId() % GROUPS
        for batch in batches if index.item_ids else ():
            terms, first = text_bytes(batch["terms"])
            null = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            heaps.add(batch["doc_id"].fill_null(0).to_numpy(), null, batch["n"].to_numpy(), first // 4, terms.view("<u4").astype(np.int64), text_bytes(batch["times"])[0].view("<u4").astype(np.int64))
        item, score, none, doc = heaps.best
        ids = pa.array(index.item_ids, pa.int64()).take(pa.array(item))
        yield pa.record_batch([pa.array(item), ids, pa.array(np.full(len(item), group, np.int64)), pa.array(doc, mask=none == 1), pa.array(score)], names=["item", "item_id", "task", "doc_id", "score"])

    heaps = found.mapInArrow(best, "item long, item_id long, task long, doc_id long, score long")
    for key in (["item", "task"], ["item"]):
        order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        heaps = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = written(heaps.select("item_id", "rank", "doc_id", "score"), "search-found")
    release(found)
    return out


def op11_reversed_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = f"unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}'))"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS term FROM documents),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, c),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // terms AS m FROM n, c),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""
