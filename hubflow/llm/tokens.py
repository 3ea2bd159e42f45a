"""Token ids of whole texts, by a public tokenizer that splits at white space and forgets it."""

import json
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.memory import give_back

#: Marks that end a run of letters or digits and start a run of their own, and are in no special token or contraction.
TAIL = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'
#: How a byte-level tokenizer shows bytes over 127 that aren't printable characters of Latin-1.
SHOWN = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Bytes of words and their ids that a worker remembers at least, some 400,000 words.
REMEMBERED = 10_000_000
#: Runs of letters or marks that go to the tokenizer's model at once.
TOGETHER = 1_000
#: Which bytes are of TAIL, and which are letters or digits of ASCII.
MARK, PLAIN = (np.isin(np.arange(256), list(x)) for x in (TAIL.encode(), bytes(c for c in range(128) if chr(c).isalnum())))


class Memory:
    """Ids of words, packed; it forgets what it hasn't been asked for since it was last full."""

    def __init__(self):
        self.words, self.ids, self.asked = pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, bool)

    def find(self, words: pa.StringArray, learn: Callable[[pa.StringArray], pa.BinaryArray]) -> pa.BinaryArray:
        """Ids of each of words, which are distinct; learn is called with those that are new."""
        at = pc.index_in(words, value_set=self.words)
        new, at = words.filter(at.is_null()), at.fill_null(-1).to_numpy().copy()
        at[at < 0] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, new])
        self.ids = pa.concat_arrays([self.ids, learn(new)])
        self.asked = np.concatenate((self.asked, np.zeros(len(new), bool)))
        self.asked[at] = True
        out = self.ids.take(pa.array(at))
        keep = pa.array(self.asked)
        words, ids = self.words.filter(keep), self.ids.filter(keep)
        if words.nbytes + ids.nbytes > REMEMBERED:
            self.words, self.ids, self.asked = words, ids, np.zeros(len(words), bool)
        return out


class Ids:
    """encode(texts): each text's ids in 2 bytes an id (little-endian), or 4 if the vocabulary needs them.

    Between spaces a text's ids depend on nothing outside, nor do those before and after a mark of TAIL that follows a
    letter or digit of ASCII. So texts are cut there, and each distinct piece is encoded once; capitals don't make it
    another. Pieces of other scripts than Latin go to the tokenizer as they are.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model, self.memory = Tokenizer(self.tokenizer.model), Memory()
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _runs(self, runs: list[str]) -> pa.BinaryArray:
        """Ids of each run: letters in lower case, or marks of TAIL, which the tokenizer's splitting leaves whole."""
        out = []
        for i in range(0, len(runs), TOGETHER):
            some = runs[i : i + TOGETHER]
            shown = " ".join(x if x.isascii() else x.encode().decode("latin-1").translate(SHOWN) for x in some)
            found = self.model.encode(shown, add_special_tokens=False)
            sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)) * self.dtype.itemsize
            places = np.append(0, sizes.cumsum()).astype(np.int32)
            out.append(pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(places), pa.py_buffer(np.array(found.ids, self.dtype))]))
        return pa.concat_arrays([pa.array([], pa.binary()), *out])

    def _learn(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of each word; one space before it is not of it."""
        runs, others, cores, marks = {}, [], [], []
        for w in words.to_pylist():
            w = w.removeprefix(" ")
            core = w if w.isalpha() else w.rstrip(TAIL)
            low = core.lower()
            if not low or low.isalpha() and (low.isascii() or max(low) <= "\u017f" >= max(core)):
                cores.append(runs.setdefault(low, len(runs)) if low else -1)
                marks.append(runs.setdefault(w[len(core) :], len(runs)) if core is not w else -1)
            else:
                others.append(array(self.code, self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes())
                cores.append(-1 - len(others))
                marks.append(-1)
        # counted from their end are the ids of no run, and before it those of others
        ids = pa.concat_arrays([self._runs(list(runs)), pa.array([*reversed(others), b""], pa.binary())])
        cores, marks = (np.array(x, np.int64) for x in (cores, marks))
        first, last = (ids.take(pa.array(np.where(x < 0, x + len(ids), x))) for x in (cores, marks))
        return pc.binary_join_element_wise(first, last, b"")

    def _encode(self, texts: pa.StringArray, end: bytes) -> pa.BinaryArray:
        starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
        data, starts = np.where(data == ord("\n"), np.uint8(ord(" ")), data), starts - starts[0]
        cut = data == ord(" ")
        cut[1:] |= MARK[data[1:]] & PLAIN[data[:-1]]
        cut[starts[starts < len(data)]] = True
        cuts = np.flatnonzero(cut)
        # an empty word stands at the end of each text
        ends = np.searchsorted(cuts, starts[1:])
        places = np.append(np.insert(cuts, ends, starts[1:]), len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        ids = self.memory.find(words.dictionary, self._learn)
        ids = pc.if_else(pc.equal(words.dictionary, ""), pa.scalar(end, pa.binary()), ids).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], np.int32)[np.append(0, ends + np.arange(1, len(starts)))]
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), ids.buffers()[2]])

    def encode(self, texts: pa.StringArray, end: bytes = b"", most: int = 8_000_000) -> pa.BinaryArray:
        """Ids of each text with end behind them, some most bytes of texts at a time."""
        texts = texts.cast(pa.string())
        sizes, out, i = pc.binary_length(texts).to_numpy().cumsum(dtype=np.int64), [pa.array([], pa.binary())], 0
        while i < len(texts):
            n = max(1, int(np.searchsorted(sizes, most + (sizes[i - 1] if i else 0), "right")) - i)
            out.append(self._encode(texts.slice(i, n), end))
            i += n
        return pa.concat_arrays(out)


@lru_cache(1)
def shared(tokenizer: str) -> Ids:
    """A worker's only Ids, kept for its next tasks."""
    return Ids(tokenizer)


def read_tokenizer(path: str) -> str:
    with open(path) as f:
        return f.read()


TOKENS = "doc_id long, part long, place long, start long, n_tokens long, ids binary"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (of the text and end_id, packed), n_tokens; part and place: the partition it was scanned in and its row there, start: ids before it in that partition.

    tokenizer is the JSON of a tokenizers file. Null texts count as empty and have only end_id. Rows keep the order
    of the scan, which is the same whenever the same files are read.
    """
    text = sc_broadcast(docs, tokenizer)

    def encode(batches):
        ids, part, place, start = shared(text.value), TaskContext.get().partitionId(), 0, 0
        width, end = ids.dtype.itemsize, np.array([end_id], ids.dtype).tobytes()
        for batch in batches:
            loads = ids.encode(batch["text"], end)
            sizes = pc.binary_length(loads).to_numpy().astype(np.int64) // width
            starts = start + np.cumsum(sizes) - sizes
            n = len(loads)
            yield pa.record_batch([batch["doc_id"], pa.array(np.full(n, part, np.int64)), pa.array(place + np.arange(n)), pa.array(starts), pa.array(sizes), loads], names=["doc_id", "part", "place", "start", "n_tokens", "ids"])
            place, start = place + n, start + int(sizes.sum())
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(encode, TOKENS)


def sc_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def id_type(tokenizer: str) -> str:
    """The packed type of ids, as Ids has it."""
    made = json.loads(tokenizer)
    top = max([*made["model"]["vocab"].values(), *(x["id"] for x in made.get("added_tokens", []))])
    return "<u2" if top < 1 << 16 else "<u4"
