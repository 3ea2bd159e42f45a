"""Fill-in-middle documents, assembled by a secondary sort: pieces meet in the order of the output, and again in that of the text."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.memory import give_back
from hubflow.llm.words import slices, text_bytes

#: Bytes of a piece at most: as many whole lines as fit, or a part of a longer line.
CHUNK = 1 << 16
#: Marks of prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
#: Places of the parts in a text, and what ends a document.
PREFIX, MIDDLE, SUFFIX, END = range(4)

_ABOUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
_PIECES = f"row long, part int, place long, {_ABOUT}, load binary"
_NAMES = ["row", "part", "place", "doc_id", "n", "form", "prefix_chars", "middle_chars"]


def chunks(data: memoryview, breaks: np.ndarray, begin: int, end: int):
    """data[begin:end] in pieces; breaks are the places after line ends in all of data, in order."""
    while begin < end:
        stop = min(begin + CHUNK, end)
        if stop < end and (i := int(np.searchsorted(breaks, stop, "right"))) and breaks[i - 1] > begin:
            stop = int(breaks[i - 1])
        yield bytes(data[begin:stop])
        begin = stop


def draws(doc_id: int | None, seed: int) -> list[int]:
    """h1 to h4 of a document; null draws as the word null."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def laid_out(doc_id: int | None, data: memoryview, seed: int, rate: int, spm: int):
    """(n, form, prefix_chars, middle_chars) and the pieces of the output, in order."""
    raw = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(raw == 10) + 1
    n = len(breaks) + int(len(raw) > 0 and raw[-1] != 10)
    h1, h2, h3, h4 = draws(doc_id, seed)
    whole = bytes(data)
    if not n or h3 % 100 >= rate or any(m in whole for m in MARKS):
        return (n, "plain", None, None), chunks(data, breaks, 0, len(raw))
    units = np.concatenate(([0], breaks, [len(raw)] if len(breaks) < n else [])).astype(np.int64)
    a, b = (int(units[i]) for i in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (chunks(data, breaks, *x) for x in ((0, a), (a, b), (b, len(raw))))
    chars = [int(np.count_nonzero(x & 0xC0 != 0x80)) for x in (raw[:a], raw[a:b])]
    p, s, m = MARKS
    if h4 % 100 < spm:
        return (n, "spm", *chars), (*[s], *suffix, *[p], *prefix, *[m], *middle)
    return (n, "psm", *chars), (*[p], *prefix, *[s], *suffix, *[m], *middle)


class Parts:
    """Cuts output that comes in pieces at its marks into parts of the text."""

    def __init__(self, form: str):
        p, s, m = ((mark, part) for mark, part in zip(MARKS, (PREFIX, SUFFIX, MIDDLE), strict=True))
        self.marks = {"psm": [p, s, m], "spm": [s, p, m], "plain": []}[form]
        self.part, self.held, self.place = PREFIX, b"", 0

    def _piece(self, load: bytes) -> list[tuple[int, int, bytes]]:
        self.place += 1
        return [(self.part, self.place, load)] if load else []

    def feed(self, load: bytes) -> list[tuple[int, int, bytes]]:
        """(part, place, bytes) of what is certain by now; the last bytes are held while they may begin a mark."""
        out, load = [], self.held + load
        while self.marks and (i := load.find(self.marks[0][0])) >= 0:
            out += self._piece(load[:i])
            load = load[i + len(self.marks[0][0]) :]
            self.part = self.marks.pop(0)[1]
        keep = min(len(load), len(MARKS[0]) - 1) if self.marks else 0
        self.held = load[len(load) - keep :]
        return out + self._piece(load[: len(load) - keep])

    def end(self) -> None:
        if self.marks or self.held:
            raise ValueError(f"the output ends before its mark {self.marks[0][0].decode()}")


def pieces(docs: DataFrame, seed: int, rate: int, spm: int) -> DataFrame:
    """One row for each piece of an output: row (of docs), place (in the output), load, and what is known about the document. A document without bytes has one empty piece."""

    def cut(batches):
        task, number = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for begin, end in slices(batch["text"]):
                data, at = text_bytes(batch["text"].slice(begin, end - begin))
                data, rows = memoryview(data), []
                for i, doc_id in enumerate(ids[begin:end]):
                    about, loads = laid_out(doc_id, data[at[i] : at[i + 1]], seed, rate, spm)
                    head = (task + number, 0, doc_id, *about)
                    rows += [(head, k, load) for k, load in enumerate(loads)] or [(head, 0, b"")]
                    number += 1
                yield _batch(rows)
            give_back()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return given.mapInArrow(cut, _PIECES)


def _batch(rows: list, more: pa.Field | None = None, values: list | None = None) -> pa.RecordBatch:
    """rows: ((row, part, doc_id, n, form, prefix_chars, middle_chars), place, load)."""
    row, part, doc, n, form, prefix, middle = zip(*(x for x, _, _ in rows), strict=True) if rows else ((),) * 7
    long = pa.int64()
    out = [pa.array(row, long), pa.array(part, pa.int32()), pa.array([x for _, x, _ in rows], long), pa.array(doc, long), pa.array(n, long), pa.array(form, pa.string()), pa.array(prefix, long), pa.array(middle, long), pa.array([x for _, _, x in rows], pa.binary())]
    names = [*_NAMES, "load"]
    if more is not None:
        out, names = [*out, pa.array(values, more.type)], [*names, more.name]
    return pa.record_batch(out, names=names)


def streamed(batches, columns: list[str]):
    """Tuples of columns, batch by batch."""
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in columns), strict=True)


def read_outputs(sorted_pieces: DataFrame) -> DataFrame:
    """The outputs, read in their order: each one's digest goes on with its last row, all others are parts of the text found at the marks."""

    def read(batches):
        field, rows, values, held, at = pa.field("output_sha256", pa.string()), [], [], 0, None
        about = parts = digest = None

        def ended():
            parts.end()
            rows.append(((at, END, *about), 0, b""))
            values.append(digest.hexdigest())

        for row, *here, load in streamed(batches, ["row", "doc_id", "n", "form", "prefix_chars", "middle_chars", "load"]):
            if row != at:
                if about is not None:
                    ended()
                if held >= 4 << 20 or len(rows) >= 20_000:
                    yield _batch(rows, field, values)
                    rows, values, held = [], [], 0
                at, about, parts, digest = row, here, Parts(here[2]), hashlib.sha256()
            digest.update(load)
            for part, place, x in parts.feed(load):
                rows.append(((row, part, *about), place, x))
                values.append(None)
                held += len(x)
            if held >= 8 << 20:  # a long document goes on in further batches
                yield _batch(rows, field, values)
                rows, values, held = [], [], 0
        if about is not None:
            ended()
        yield _batch(rows, field, values)

    return sorted_pieces.mapInArrow(read, f"{_PIECES}, output_sha256 string")


def restored(sorted_parts: DataFrame) -> DataFrame:
    """One row for each document, with the digest of its text put together again."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    def read(batches):
        digest, rows = hashlib.sha256(), []
        for part, load, *about in streamed(batches, ["part", "load", *names[:-1]]):
            if part != END:
                digest.update(load)
                continue
            rows.append((*about, digest.hexdigest()))
            digest = hashlib.sha256()
            if len(rows) == 20_000:
                yield made(rows)
                rows = []
        yield made(rows)

    def made(rows):
        long, text = pa.int64(), pa.string()
        columns = zip(*rows, strict=True) if rows else ((),) * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (long, long, text, long, long, text, text), strict=True)], names=names)

    return sorted_parts.mapInArrow(read, f"{_ABOUT}, output_sha256 string, restored_sha256 string")


def assembled(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """The pieces of all outputs, each output's in one partition and in order: a shuffle by row whose partitions are sorted by (row, place), so no output is held in memory.

    Joined in the order of place, the loads of a row are its output.
    """
    return pieces(docs, seed, rate, spm).repartition("row").sortWithinPartitions("row", "place")


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output_sha256, restored_sha256, a row for each row of docs.

    A document of n lines is cut after the smaller and the larger of two seeded draws into prefix, middle and suffix; rate
    in 100 become psm or (spm in 100 of them) spm, others and those that are empty or hold a mark stay plain. The
    outputs are streamed from assembled into digests, cut at their marks, and the parts sorted once more within
    their partitions, now in the order of the text, for the restored text's digest.

    Null texts count as empty. Rows are told apart by their place, so repeated ones and equal doc_ids don't mix; a null
    doc_id draws as the word null. Lines over CHUNK bytes are cut, so of a long text a task holds, beyond
    the row it was read from, one batch. Other columns are ignored. An empty table gives no rows.
    """
    read = read_outputs(assembled(docs, seed, rate, spm))
    return restored(read.sortWithinPartitions("row", "part", "place"))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_H = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents),
e AS (SELECT *, len(u) AS n, {_H} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM g"""
