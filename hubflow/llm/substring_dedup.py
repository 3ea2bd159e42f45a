"""Substring dedup by level-wise doubling.

Windows are looked at level by level, each of twice the words of the one before, from a base of at least BASE words up to the window asked for:
only windows that hold what was repeated at the level before are looked at at the next, until none survive. Of the
windows of a lower level only anchors are sent: the smallest hash among those inside each window of the next level, so two
equal windows always have the same anchor and no repeat is missed, while about one in six is sent. No window
longer than the one asked for is needed: all its words are covered by repeated windows of that length already.

What is sent are rows of hashes, distinct within a chunk of some MB of text, so they grow with the text alone, and a
passage that all documents hold comes once from each chunk. A text is shuffled once; that exchange is used by all levels.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm import parcels
from hubflow.llm.memory import lean
from hubflow.llm.words import Words, combine, runs, shifted

#: Words of the first level's windows at least.
BASE = 10
LONG = pa.int64()


def levels(window: int, base: int = BASE) -> list[int]:
    """Lengths of the levels: window, its half, the half of that, as long as they are at least base, and one below window at least; ascending."""
    if window < 2:
        raise ValueError("a window has two words at least")
    out = [window]
    while out[-1] // 2 >= base or len(out) == 1:
        out.append(out[-1] // 2)
    return out[::-1]


class Windows:
    """A chunk's windows of one level, in ascending order of doc_id (null last), then place of the row."""

    def __init__(self, docs: pa.Table, lengths: list[int]):
        self.docs = docs = docs.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        self.words, self.lengths = Words(docs["text"]), lengths
        self.hashes = [runs(self.words.hash, lengths[0])]
        for n in lengths[1:]:
            half = self.hashes[-1]
            full = combine(half, shifted(half, n // 2 + n % 2))
            self.hashes.append(combine(full, shifted(self.words.hash, n // 2)) if n % 2 else full)

    def starts(self, level: int) -> np.ndarray:
        return np.flatnonzero(self.words.left() >= self.lengths[level])

    def anchor_places(self, level: int, starts: np.ndarray) -> np.ndarray:
        """Where the smallest window of the level before begins inside each window of level, the first of equals."""
        value, n = self.hashes[level - 1], len(self.words.hash)
        span, at, width = self.lengths[level] - self.lengths[level - 1] + 1, np.arange(n), 1
        while width < span:
            by = min(width, span - width)
            other = np.minimum(np.arange(n) + by, max(n - 1, 0))
            later = value[other] < value
            value, at, width = np.where(later, value[other], value), np.where(later, at[other], at), width + by
        return at[starts]

    def candidates(self, level: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the level's windows whose anchor is among repeated or occurs twice in the chunk, and their anchors."""
        starts = self.starts(level)
        places = self.anchor_places(level, starts)
        anchor = self.hashes[level - 1][places]
        own, counts = np.unique(self.hashes[level - 1][np.unique(places)], return_counts=True)
        repeated = np.union1d(own[counts > 1], repeated)
        at = np.minimum(np.searchsorted(repeated, anchor), max(len(repeated) - 1, 0))
        keep = repeated[at] == anchor if len(repeated) else np.zeros(len(anchor), bool)
        return starts[keep], anchor[keep]

    def first_of_kind(self, starts: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Which of the candidates (of the last level) are the first of their kind in the chunk: equal ones have both hashes equal."""
        full = self.hashes[-1][starts]
        order = np.lexsort((starts, full, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (full[order][1:] != full[order][:-1])
        out = np.zeros(len(order), bool)
        out[order[new]] = True
        return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def remove_repeats(docs: DataFrame, window: int = 20, chunk_bytes: int = parcels.CHUNK_BYTES, keep: tuple[str, ...] = (), as_is: bool = False, base: int = BASE) -> DataFrame:
    """doc_id, kept (text of the kept words, joined by one space), n_words, n_removed and the columns keep, for each row of docs (doc_id, text, ...).

    A word goes if a window of so many words that covers it also starts earlier: in a smaller doc_id, or in the same
    document further left. Null texts and texts without words give an empty kept text and zeros; texts shorter than
    the window lose nothing. Null doc_ids come last; rows with equal doc_ids count one after the other, in the order in which
    they are read. Other columns of docs are ignored. An empty table gives an empty one. With as_is, kept is the text itself
    where nothing goes. Windows are equal where two hashes of 64 bits are, of themselves and of their anchor.
    """
    given = docs.schema
    docs, chunks = parcels.deal(docs, chunk_bytes, keep)
    names, lengths = ["doc_id", "kept", "n_words", "n_removed"], levels(window, base)
    dealt = docs.groupBy("chunk")

    def anchors(level: int, key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], LONG)] * 2, names=["hash", "chunk"])
        w = Windows(table, lengths[: level + 1])
        places = np.unique(w.anchor_places(level, w.starts(level)))
        if replies is not None:
            # an anchor that was no candidate at its own level isn't repeated
            places = np.intersect1d(places, w.candidates(level - 1, replies["hash"].to_numpy().view(np.uint64))[0])
        own = np.unique(w.hashes[level - 1][places])
        return pa.table([signed(own), pa.array(np.full(len(own), key[0].as_py(), np.int64))], names=["hash", "chunk"])

    def repeated(sent: DataFrame) -> DataFrame:
        """Rows (hash, chunk) of hashes that several chunks have sent."""
        n = F.count("*").over(Window.partitionBy("hash"))
        return sent.withColumn("n", n).where("n > 1").select("hash", "chunk")

    def first_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return anchors(1, key, table)

    def next_anchors(level: int):
        return lambda key, table, replies: anchors(level, key, table, replies)

    found = repeated(dealt.applyInArrow(lean(first_anchors), "hash long, chunk long"))
    for level in range(2, len(lengths)):
        found = repeated(dealt.cogroup(found.groupBy("chunk")).applyInArrow(lean(next_anchors(level)), "hash long, chunk long"))

    columns = [("anchor", LONG), ("full", LONG), ("doc", LONG), ("row", LONG), ("place", LONG)]

    def windows(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema(columns).empty_table()
        w = Windows(table, lengths)
        starts, anchor = w.candidates(len(lengths) - 1, replies["hash"].to_numpy().view(np.uint64))
        one = w.first_of_kind(starts, anchor)
        starts, anchor = starts[one], anchor[one]
        text = w.words.text[starts]
        doc = w.docs["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()[text]
        return pa.table([signed(anchor), signed(w.hashes[-1][starts]), pa.array(doc), pa.array(w.docs["row"].to_numpy()[text]), pa.array(starts - w.words.first[text])], schema=pa.schema(columns))

    def kept(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], LONG), pa.array([], pa.string()), *[pa.array([], LONG)] * 2, *(table[f"keep{i}"] for i in range(len(keep)))], names=[*names, *(f"keep{i}" for i in range(len(keep)))])
        w = Windows(table, lengths)
        first = w.words.first
        starts, anchor = w.candidates(len(lengths) - 1, np.zeros(0, np.uint64))
        again = starts[~w.first_of_kind(starts, anchor)]  # of a kind that the chunk itself has earlier
        by_row = np.argsort(w.docs["row"].to_numpy())
        text = by_row[np.searchsorted(w.docs["row"].to_numpy()[by_row], replies["row"].to_numpy())]
        later = np.concatenate((again, first[text] + replies["place"].to_numpy()))
        cover = np.zeros(len(w.words.hash) + 1, np.int32)
        np.add.at(cover, later, 1)
        np.add.at(cover, later + window, -1)
        stay = np.cumsum(cover)[:-1] == 0
        out, removed = [], []
        for i, text in enumerate(w.docs["text"].to_pylist()):
            here = stay[first[i] : first[i + 1]]
            removed.append(len(here) - int(here.sum()))
            if as_is and not removed[-1]:
                out.append(text)
                continue
            words = text.encode().split()
            out.append(b" ".join([x for x, ok in zip(words, here.tolist(), strict=True) if ok] if removed[-1] else words).decode())
        return pa.table([w.docs["doc_id"], pa.array(out, pa.string()), pa.array(np.diff(first), LONG), pa.array(removed, LONG), *(w.docs[f"keep{i}"] for i in range(len(keep)))], names=[*names, *(f"keep{i}" for i in range(len(keep)))])

    sent = dealt.cogroup(found.groupBy("chunk")).applyInArrow(lean(windows), ", ".join(f"{n} long" for n, _ in columns))
    earlier = F.row_number().over(Window.partitionBy("full", "anchor").orderBy("doc", "row", "place")) - 1
    later = sent.withColumn("earlier", earlier).where("earlier > 0").select(parcels.chunk_of("row", chunks).alias("chunk"), "row", "place")
    kinds = ["long", "string", "long", "long", *(given[c].dataType.simpleString() for c in keep)]
    schema = ", ".join(f"{n} {k}" for n, k in zip([*names, *(f"keep{i}" for i in range(len(keep)))], kinds, strict=True))
    out = dealt.cogroup(later.groupBy("chunk")).applyInArrow(lean(kept), schema)
    return out.select(*names, *(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: A word goes if one of the 20 windows that cover it isn't the first of its kind.
OP1_SQL = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    p AS (SELECT doc_id, words, len(words) AS n, unnest(range(1, len(words) + 1)) AS i FROM w),
    s AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + 19 <= n THEN array_to_string(words[i:i + 19], ' ') END AS run FROM p),
    r AS (SELECT doc_id, i, word, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS later FROM s),
    c AS (SELECT doc_id, i, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
    k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
    FROM w LEFT JOIN k USING (doc_id)"""
