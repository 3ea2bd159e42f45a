"""A hierarchical Pitman-Yor model of words: a restaurant for each word that comes before, all sharing one parent.

A customer of a context's restaurant is an occurrence of a word behind that context, its dish; each table sends one
customer to the parent, whose own tables draw from all known words and one for the unknown, alike. Seatings are sampled
by Gibbs in rounds: all contexts given a rough parent, the parent given their tables, all contexts given that parent,
with the predictive probabilities of the last sweeps averaged. In each sweep every customer is seated anew. Contexts are
dealt into buckets by hash, those of very many customers in parts by word; what the words of a restaurant and the
parent have to know of each other travels packed, and only where there is something to say.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm import parcels
from hubflow.llm.words import Words

#: Strengths of contexts and parent, sweeps of the rough round, and of the last one (not counted, averaged).
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
ROUGH, BURN_IN, AVERAGED = 3, 3, 4
#: Dishes of at most so many customers have their tables drawn at once; those of more are seated anew in so many batches.
SMALL, BATCHES = 512, 8
#: Training customers of a context for each part that its restaurant is dealt into.
PART = 200_000
#: What stands for the start of a text (a context only) and for its end (a token).
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
SENT = "kind int, to long, of long, load binary, a double, b double, c double"
LONG = pa.int64()


def discount(counts: np.ndarray) -> float:
    """From how many dishes have one customer and how many two, as for Kneser-Ney."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def log_stirling(n: int, d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [c, t] for c customers at t tables under discount d."""
    out = np.full((n + 1, n + 1), -np.inf)
    if n:
        out[1, 1] = 0.0
    for c in range(1, n):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], out[c, 1 : c + 2] + np.log(np.maximum(c - d * t, 0)))
    return out


class Seating:
    """Tables of each dish. count: its customers; room: the number of its restaurant; parent: its probability there; scale: of each room, its tables in all by those seen here.

    Given the other tables of its room, the number of a dish's tables has a known distribution, from which it is drawn where
    a dish has at most SMALL customers. Of larger dishes the tables' sizes are kept, and a sweep takes all customers off them and seats
    them anew, in batches. Dishes of a room move in two halves, each given the room's last state.
    """

    def __init__(self, count: np.ndarray, room: np.ndarray, rooms: int, parent: np.ndarray, d: float, strength: float, seed: int, scale: np.ndarray | float = 1.0):
        self.d, self.strength, self.scale, self.room, self.rooms = d, strength, scale, room, rooms
        self.rng = np.random.default_rng(seed)
        self.count, self.parent = count.astype(np.int64), parent
        self.tables = np.ones(len(count), np.int64)
        self.in_room = np.bincount(room, minlength=rooms) * scale
        self.stirling = log_stirling(min(SMALL, int(count.max(initial=0))), d)
        small = np.flatnonzero((count > 1) & (count <= SMALL))
        small = small[np.argsort(count[small], kind="stable")]
        ends = np.flatnonzero(np.append(np.diff(count[small]) != 0, len(small) > 0)) + 1
        self.small = np.split(small, ends[:-1]) if len(small) else []
        self.large = np.flatnonzero(count > SMALL)
        # large dishes start from as many tables as SMALL of their customers would take, one of them with all others
        if len(self.large):
            self._draw(self.large, SMALL)
            self._counted()
        t = self.tables[self.large]
        self.dish, self.size = np.repeat(np.arange(len(t)), t), np.ones(int(t.sum()), np.int64)
        self.size[np.cumsum(t) - t] = self.count[self.large] - t + 1

    def _counted(self) -> None:
        self.in_room = np.bincount(self.room, self.tables, self.rooms) * self.scale

    def sweep(self) -> None:
        """Every customer of every dish is seated anew."""
        for half in (0, 1):
            for of in self.small:
                some = of[half::2]
                if len(some):
                    self._draw(some, int(self.count[some[0]]))
            self._counted()
        if len(self.large):
            for _ in range(BATCHES):
                self._reseat()
                self._counted()

    def _draw(self, of: np.ndarray, c: int, most: int = 1_000_000) -> None:
        """The tables of dishes of c customers each, from their distribution given all others."""
        rows = max(1, most // c)
        for begin in range(0, len(of), rows):
            some = of[begin : begin + rows]
            others = np.maximum(self.in_room[self.room[some]] - self.tables[some], 0)
            # weights of 1, 2, ... tables as products of their ratios; beyond what a double holds, by logarithms
            weight = np.ones((len(some), c))
            np.multiply(self.ratio(c), self.strength + self.d * (others[:, None] + np.arange(1, c)), out=weight[:, 1:])
            weight[:, 1:] *= self.parent[some][:, None]
            with np.errstate(over="ignore", invalid="ignore"):
                weight = np.cumsum(np.cumprod(weight, 1), 1)
            far = np.flatnonzero(~np.isfinite(weight[:, -1]))
            if len(far):
                step = np.log(self.strength + self.d * (others[far, None] + np.arange(c))) + np.log(self.parent[some[far]])[:, None]
                log = self.stirling[c, 1 : c + 1] + np.cumsum(step, 1)
                weight[far] = np.cumsum(np.exp(log - log.max(1, keepdims=True)), 1)
            self.tables[some] = 1 + (weight < (self.rng.random(len(some)) * weight[:, -1])[:, None]).sum(1)

    def ratio(self, c: int) -> np.ndarray:
        """Of Stirling numbers of t + 1 and t tables, for t from 1 to c - 1."""
        return np.exp(np.diff(self.stirling[c, 1 : c + 1]))

    def _reseat(self) -> None:
        """One customer in BATCHES of each large dish, any of them alike, leaves and is seated anew."""
        n = len(self.large)
        gone = self.rng.binomial(self.size, 1 / BATCHES)
        left = np.bincount(self.dish, gone, n).astype(np.int64)
        stay = self.size > gone
        self.dish, self.size = self.dish[stay], (self.size - gone)[stay]
        self._seat(left, self.count[self.large] - left)

    def _seat(self, come: np.ndarray, seated: np.ndarray) -> None:
        """So many customers of each large dish take seats beside those seated, each on its own."""
        n = len(self.large)
        tables = np.bincount(self.dish, minlength=n)
        others = np.maximum(self.in_room[self.room[self.large]] - self.tables[self.large] + tables, tables)
        new = (self.strength + self.d * others) * self.parent[self.large]
        old = np.maximum(seated - self.d * tables, 0.0) + np.maximum(come - 1, 0) / 2
        opened = self.rng.binomial(come, new / (new + old))
        # a dish that all have left opens its first table, for all who open none
        opened = np.where((tables == 0) & (come > 0), np.maximum(opened, 1), opened)
        weight, last = np.append(np.cumsum(self.size - self.d), 0.0), np.cumsum(tables)
        top, bottom = (np.where(at > 0, weight[np.maximum(at, 1) - 1], 0.0) for at in (last, last - tables))
        who = np.repeat(np.arange(n), np.where(tables > 0, come - opened, 0))
        at = np.searchsorted(weight[:-1], bottom[who] + self.rng.random(len(who)) * (top - bottom)[who], "right")
        self.size = self.size + np.bincount(np.clip(at, (last - tables)[who], last[who] - 1), minlength=len(self.size))
        fresh = np.repeat(np.arange(n), opened)
        size = np.ones(len(fresh), np.int64)
        alone = np.flatnonzero((tables == 0) & (come > opened))
        size[np.searchsorted(fresh, alone)] += (come - opened)[alone]
        dish, size = np.concatenate((self.dish, fresh)), np.concatenate((self.size, size))
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], size[order]
        self.tables[self.large] = np.bincount(self.dish, minlength=n)


class Texts:
    """The tokens of a chunk's documents: word (number in own), before (that of the token before, or of START), doc; own: distinct hashes by bucket and value; trained: their number in training documents."""

    def __init__(self, docs: pa.Table, n_buckets: int):
        self.docs = docs = docs.sort_by("row")
        w, n = Words(docs["text"], lower=True), docs.num_rows
        self.sizes = np.diff(w.first) + 1
        tokens = np.insert(w.hash, w.first[1:], END)
        self.doc = np.repeat(np.arange(n), self.sizes)
        own, self.word = np.unique(np.concatenate((tokens, [START])), return_inverse=True)
        bucket = (own % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((own, bucket))
        self.own, self.bucket = own[order], bucket[order]
        self.word = np.argsort(order)[self.word]
        self.start, self.word = self.word[-1], self.word[:-1]
        self.before = np.concatenate(([self.start], self.word[:-1]))
        self.before[np.cumsum(self.sizes) - self.sizes] = self.start
        self.train = ~docs["held_out"].to_numpy(zero_copy_only=False)[self.doc]
        self.trained = np.bincount(self.word[self.train], minlength=len(own))
        self.buckets, self.begins = np.unique(self.bucket, return_index=True)
        self.ends = np.append(self.begins[1:], len(own))


class Pairs:
    """Distinct (context, word) of a chunk by bucket, context and word; of: the pair of each token; context: where each context's pairs begin in each bucket; parts: of how many parts its restaurant is."""

    def __init__(self, texts: Texts, ids: np.ndarray, counts: np.ndarray, start_parts: int, part_size: int, n_buckets: int):
        key, self.of = np.unique(texts.before * len(ids) + texts.word, return_inverse=True)
        before, word = key // max(1, len(ids)), key % max(1, len(ids))
        parts = 1 + counts // part_size
        parts[texts.start] = start_parts
        # a part's pairs go to a bucket of their own; a context of one part stays together
        part = (ids[word] // n_buckets) % parts[before]
        bucket = (ids[before] + part * 7919) % n_buckets
        order = np.lexsort((ids[word], ids[before], bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of, self.own_before, self.own_word = place[self.of], before[order], word[order]
        self.before, self.word, bucket = ids[self.own_before], ids[self.own_word], bucket[order]
        self.trained = np.bincount(self.of[texts.train], minlength=len(key))
        new = np.ones(len(key), bool)
        new[1:] = (self.before[1:] != self.before[:-1]) | (bucket[1:] != bucket[:-1])
        self.context = np.flatnonzero(new)
        self.room = np.cumsum(new) - 1
        self.parts = parts[self.own_before[self.context]]
        self.buckets, self.begins = np.unique(bucket, return_index=True)
        self.ends = np.append(self.begins[1:], len(key))


def sent(rows: list[tuple], totals: list[tuple] = ()) -> pa.Table:
    """Rows (kind, to, of, load), and rows (kind, to, a, b, c) of numbers."""
    rows = [(*r, None, None, None) for r in rows] + [(k, to, None, None, float(a), float(b), float(c)) for k, to, a, b, c in totals]
    columns = zip(*rows, strict=True) if rows else ([],) * 7
    kinds = [pa.int32(), LONG, LONG, pa.binary(), *[pa.float64()] * 3]
    return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SENT.split(", ")])


def loads(table: pa.Table, kind: int) -> list[tuple[int, list[np.ndarray]]]:
    """(of, arrays) of the rows of a kind, in order of of."""
    some = [(o, x) for k, o, x in zip(table["kind"].to_pylist(), table["of"].to_pylist(), table["load"].to_pylist(), strict=True) if k == kind]
    return [(o, parcels.unpack(x)) for o, x in sorted(some, key=lambda r: r[0])]


def totals_of(table: pa.Table, kind: int) -> np.ndarray:
    """The three numbers of the rows of a kind, added up."""
    some = [x for k, *x in zip(*(table[c].to_pylist() for c in ("kind", "a", "b", "c")), strict=True) if k == kind]
    return np.array(some, float).reshape(-1, 3).sum(0)


def lexicon(rows: list[tuple[int, list[np.ndarray]]], bucket: int, n_buckets: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For a bucket's words: their ids and training counts as each chunk has sent them, and the counts. Ids are by falling count: common words have small ones."""
    hashes, counts = np.concatenate([x[0] for _, x in rows]), np.concatenate([x[1] for _, x in rows]).astype(np.int64)
    own, of = np.unique(hashes, return_inverse=True)
    total = np.bincount(of, counts, len(own)).astype(np.int64)
    ids = np.empty(len(own), np.int64)
    ids[np.lexsort((own, -total))] = np.arange(len(own)) * n_buckets + bucket
    ends = np.cumsum([len(x[0]) for _, x in rows])[:-1]
    return np.split(ids[of], ends), np.split(total[of], ends), total


def parent_seating(rows: list[tuple[int, list[np.ndarray]]], n_buckets: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of the dishes in a bucket of the parent, their customers less the discounts of their tables, and [customers, discounts, dishes] in all."""
    ids, of = np.unique(np.concatenate([x[0] for _, x in rows]), return_inverse=True)
    customers = np.bincount(of, np.concatenate([x[1] for _, x in rows]), len(ids)).astype(np.int64)
    d = discount(customers)
    # dishes are dealt by hash: a bucket's tables and dishes stand for all
    seats = Seating(customers, np.zeros(len(ids), np.int64), 1, np.full(len(ids), 1 / (len(ids) * n_buckets + 1)), d, PARENT_STRENGTH, seed, n_buckets)
    tables = np.zeros(len(ids))
    for i in range(BURN_IN + AVERAGED):
        seats.sweep()
        if i >= BURN_IN:
            tables += seats.tables / AVERAGED
    return ids, customers - d * tables, np.array([customers.sum(), d * tables.sum(), len(ids)], float)


def parent_probability(value: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Of dishes with these customers less discounts (0: unknown), from [customers, discounts, dishes] of all buckets."""
    customers, discounts, dishes = totals
    return (value + (PARENT_STRENGTH + discounts) / (dishes + 1)) / (PARENT_STRENGTH + customers)


class Contexts:
    """The whole restaurants of a bucket, or its parts of those that are split: distinct pairs with training customers, from the pairs that all chunks have sent. pairs, runs: which of those sent are of these."""

    def __init__(self, rows: list[tuple[int, list[np.ndarray]]], split: bool, seed: int):
        before, size, word, trained, parts = (np.concatenate([x[k] for _, x in rows]).astype(np.int64) for k in range(5))
        self.runs = np.flatnonzero((parts > 1) == split)
        self.pairs = np.flatnonzero(np.repeat((parts > 1) == split, size))
        before, size, parts, word, trained = before[self.runs], size[self.runs], parts[self.runs], word[self.pairs], trained[self.pairs]
        self.room_ids, first, self.room_of_run = np.unique(before, return_index=True, return_inverse=True)
        self.words, dish = np.unique(word, return_inverse=True)
        key, self.of = np.unique(np.repeat(self.room_of_run, size) * len(self.words) + dish, return_inverse=True)
        self.room, self.dish = key // max(1, len(self.words)), key % max(1, len(self.words))
        self.count = np.bincount(self.of, trained, len(key)).astype(np.int64)
        self.known = np.flatnonzero(self.count)
        self.parts, self.seed = parts[first].astype(float), 2 * seed + split

    def seat(self, d: float) -> None:
        """Under that discount, given a rough parent."""
        here = np.bincount(self.dish, self.count, len(self.words))
        rough = here[self.dish[self.known]] / (here.sum() + 1)
        self.seats = Seating(self.count[self.known], self.room[self.known], len(self.room_ids), rough, d, STRENGTH, self.seed, self.parts)
        for _ in range(ROUGH):
            self.seats.sweep()

    def to_parent(self) -> tuple[np.ndarray, np.ndarray]:
        """Words with tables here, and how many."""
        tables = np.bincount(self.dish[self.known], self.seats.tables, len(self.words)).astype(np.int64)
        return self.words[tables > 0], tables[tables > 0]

    def predictive(self, ids: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair its customers less the discounts of its tables, and of each context the discounts of all tables here, averaged over sweeps given the parent's probabilities of ids (ascending, all words with tables among them)."""
        s, d = self.seats, self.seats.d
        s.parent = parent[np.searchsorted(ids, self.words[self.dish[self.known]])]
        own, ask = np.zeros(len(self.count)), np.zeros(len(self.room_ids))
        for i in range(BURN_IN + AVERAGED):
            s.sweep()
            if i >= BURN_IN:
                own[self.known] += (self.count[self.known] - d * s.tables) / AVERAGED
                ask += d * np.bincount(s.room, s.tables, s.rooms) / AVERAGED
        return own, ask


SCORES = [("doc_id", LONG), ("held_out", pa.bool_()), ("n_tokens", LONG), ("n_known", LONG), ("train_tokens", LONG), ("base_score", pa.float64()), ("score", pa.float64()), ("token_scores", pa.list_(pa.float64()))]


def score(docs: DataFrame, held_out, seed: int = 6, chunk_bytes: int = parcels.CHUNK_BYTES, part_size: int = PART, token_scores: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text, ...), and token_scores if asked for: the log10 probability of each token.

    Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z in lower case and one end of each text (null: empty). The model learns
    from the documents where held_out (a condition on doc_id; null counts as false) is not true, and scores all of them:
    score is the log10 probability of all tokens, each given the one before; base_score that of single tokens with 0.5
    added to each count. Without training documents every token is unknown, and both scores are 0: there is nothing else that a token could be. Rows of one
    doc_id each count. Other columns are ignored.
    """
    docs, chunks = parcels.deal(docs, chunk_bytes)
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    word_buckets, context_buckets, start_parts = parcels.buckets(chunks), max(12, chunks // 4), max(1, chunks // 16)
    schema = pa.schema(SCORES if token_scores else SCORES[:-1])

    def words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = Texts(table, word_buckets)
        rows = [(1, b, key[0].as_py(), parcels.pack(t.own[i:j], t.trained[i:j].astype(np.uint32))) for b, i, j in zip(t.buckets.tolist(), t.begins, t.ends, strict=True)]
        return sent(rows)

    def known_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, rows = key[0].as_py(), loads(table, 1)
        ids, counts, total = lexicon(rows, bucket, word_buckets)
        narrow = np.int64 if len(total) * word_buckets >> 31 else np.uint32
        replies = [(2, of, bucket, parcels.pack(i.astype(narrow), c)) for (of, _), i, c in zip(rows, ids, counts, strict=True)]
        return sent(replies, [(8, -1, total.sum(), (total > 0).sum(), 0)])

    def with_ids(table: pa.Table, replies: pa.Table) -> tuple[Texts, Pairs, np.ndarray]:
        t = Texts(table, word_buckets)
        rows = [x for _, x in loads(replies, 2)]
        ids, counts = (np.concatenate([x[k] for x in rows]).astype(np.int64) for k in (0, 1))
        return t, Pairs(t, ids, counts, start_parts, part_size, context_buckets), counts

    def pairs(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent([])
        _, p, _ = with_ids(table, replies)
        rows, narrow = [], p.word.dtype if max(p.word.max(), p.before.max()) >> 31 else np.uint32
        for b, i, j in zip(p.buckets.tolist(), p.begins, p.ends, strict=True):
            some = slice(p.room[i], p.room[j - 1] + 1)
            begin = p.context[some]
            rows.append((3, b, key[0].as_py(), parcels.pack(p.before[begin].astype(narrow), np.diff(np.append(begin, j)).astype(np.uint32), p.word[i:j].astype(narrow), p.trained[i:j].astype(np.uint32), p.parts[some].astype(np.uint32))))
        return sent(rows)

    def seated(bucket: int, rows: list, kinds: tuple[bool, ...] = (False, True)) -> list[Contexts]:
        return [Contexts(rows, split, seed * 1_000_003 + bucket) for split in kinds]

    def tables_in(contexts: list[Contexts]) -> tuple[np.ndarray, np.ndarray, float]:
        """Words with tables in a bucket, how many, and the discount of all its restaurants."""
        d = discount(np.concatenate([c.count[c.known] for c in contexts]))
        for c in contexts:
            c.seat(d)
        ids, customers = (np.concatenate(x) for x in zip(*(c.to_parent() for c in contexts), strict=True))
        ids, of = np.unique(ids, return_inverse=True)
        return ids, np.bincount(of, customers, len(ids)).astype(np.int64), d

    def by_bucket(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order of ids by bucket of words and id, and (bucket, begin, end) of each bucket with some."""
        order = np.lexsort((ids, ids % word_buckets))
        own, begins = np.unique(ids[order] % word_buckets, return_index=True)
        ends = [*begins[1:].tolist(), len(ids)] if len(ids) else []
        return order, list(zip(own.tolist(), begins.tolist(), ends, strict=True))

    def tables(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, customers, d = tables_in(seated(key[0].as_py(), loads(table, 3)))
        order, parts = by_bucket(ids)
        return sent([(4, b, key[0].as_py(), parcels.pack(ids[order][i:j], customers[order][i:j].astype(np.uint32), np.array([d]))) for b, i, j in parts])

    def parent(bucket: int, table: pa.Table):
        rows = loads(table, 4)
        return rows, *parent_seating(rows, word_buckets, seed * 1_000_033 + bucket)

    def lookup(ids: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ids, wanted), max(len(ids) - 1, 0))
        return np.where(ids[at] == wanted, values[at], 0.0).astype(np.float32) if len(ids) else np.zeros(len(wanted), np.float32)

    def parent_to_contexts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rows, ids, values, stats = parent(bucket, table)
        return sent([(5, o, bucket, parcels.pack(x[0], lookup(ids, values, x[0]), x[2])) for o, x in rows], [(9, -1, *stats)])

    def parent_to_chunks(key: tuple[pa.Scalar, ...], words: pa.Table, table: pa.Table) -> pa.Table:
        bucket, rows = key[0].as_py(), loads(words, 1)
        if not rows:
            return sent([])
        ids, values = parent(bucket, table)[1:3] if loads(table, 4) else (np.zeros(0, np.int64), np.zeros(0))
        asked = [x for _, x in loads(table, 10)] or [[np.zeros(0, np.int64), np.zeros(0)]]
        contexts, of = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
        asked = np.bincount(of, np.concatenate([x[1] for x in asked]), len(contexts))
        return sent([(6, of, bucket, parcels.pack(lookup(ids, values, i), lookup(contexts, asked, i))) for (of, _), i in zip(rows, lexicon(rows, bucket, word_buckets)[0], strict=True)])

    def answered(bucket: int, table: pa.Table, replies: pa.Table, kinds: tuple[bool, ...]):
        """What chunks have sent, and of each kind of contexts what their final sweeps give."""
        rows = loads(table, 3)
        given = [x for _, x in loads(replies, 5)]
        ids, value, d = (np.concatenate([x[k] for x in given] or [np.zeros(0)]) for k in range(3))
        order = np.argsort(ids)
        ids, value = ids[order], parent_probability(value[order].astype(float), totals_of(replies, 9))
        contexts = seated(bucket, rows, kinds)
        for c in contexts:
            c.seat(float(d[0]) if len(d) else 0.5)
        return rows, [(c, *c.predictive(ids, value)) for c in contexts]

    def predictive(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent([])
        rows, found = answered(key[0].as_py(), table, replies, (False, True))
        runs, pairs = (np.cumsum([len(x[k]) for _, x in rows]) for k in (0, 2))
        own, ask = np.zeros(int(pairs[-1]), np.float32), np.zeros(int(runs[-1]), np.float32)
        for c, mine, asked in found:
            own[c.pairs], ask[c.runs] = mine[c.of], asked[c.room_of_run]
        return sent([(7, of, key[0].as_py(), parcels.pack(x, y)) for (of, _), x, y in zip(rows, np.split(own, pairs[:-1]), np.split(ask, runs[:-1]), strict=True)])

    def asked_by_parts(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        """What the parts of split contexts ask the parent, by way of the context's word, so that a chunk needs no answer of each part."""
        if not table.num_rows or not any((x[4] > 1).any() for _, x in loads(table, 3)):
            return sent([])
        _, ((c, _, ask),) = answered(key[0].as_py(), table, replies, (True,))
        order, parts = by_bucket(c.room_ids)
        return sent([(10, b, key[0].as_py(), parcels.pack(c.room_ids[order][i:j], ask[order][i:j])) for b, i, j in parts])

    def scores(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        t, p, counts = with_ids(table, replies)
        train_tokens, known, train_docs = totals_of(replies, 8)
        root, of_parts = (np.concatenate([x[k] for _, x in loads(replies, 6)]).astype(float) for k in (0, 1))
        root = parent_probability(root, totals_of(replies, 9))
        answers = [x for _, x in loads(replies, 7)]
        own, ask = (np.concatenate([x[k] for x in answers]).astype(float) for k in (0, 1))
        customers = counts.copy()
        customers[t.start] = int(train_docs)
        asked = of_parts
        whole = p.parts == 1
        asked[p.own_before[p.context[whole]]] = ask[whole]
        before = p.own_before
        probability = (own + (STRENGTH + asked[before]) * root[p.own_word]) / (STRENGTH + customers[before])
        log = np.log10(probability)[p.of]
        base = np.log10((counts + 0.5) / (train_tokens + 0.5 * (known + 1)))
        n = len(t.sizes)
        columns = [t.docs["doc_id"].combine_chunks(), t.docs["held_out"].combine_chunks(), pa.array(t.sizes, LONG), pa.array(np.bincount(t.doc, counts[t.word] > 0, n).astype(np.int64)), pa.array(np.full(n, int(train_tokens), np.int64)), pa.array(np.bincount(t.doc, base[t.word], n)), pa.array(np.bincount(t.doc, log, n))]
        if token_scores:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(t.sizes)).astype(np.int32)), pa.array(log)))
        return pa.table(columns, schema=schema)

    kind = lambda df, k: df.where(F.col("kind") == k)
    summed = lambda df: df.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in "abc"))

    def to_each(totals: DataFrame, k: int, n: int) -> DataFrame:
        """One row of totals for each of n chunks or buckets."""
        every = docs.sparkSession.range(n).crossJoin(F.broadcast(totals))
        return every.select(F.lit(k).alias("kind"), F.col("id").alias("to"), F.lit(None).cast("long").alias("of"), F.lit(None).cast("binary").alias("load"), "a", "b", "c")

    dealt = docs.groupBy("chunk")
    word_rows = dealt.applyInArrow(words, SENT)
    asked = word_rows.groupBy("to")
    lexicon_all = asked.applyInArrow(known_words, SENT)
    learned = docs.agg(F.count_if(~F.col("held_out")).cast("double").alias("c"))
    lexicon_rows, counted = kind(lexicon_all, 2), summed(kind(lexicon_all, 8)).drop("c").crossJoin(F.broadcast(learned))
    pair_rows = dealt.cogroup(lexicon_rows.groupBy("to")).applyInArrow(pairs, SENT).groupBy("to")
    table_rows = pair_rows.applyInArrow(tables, SENT)
    parent_all = table_rows.groupBy("to").applyInArrow(parent_to_contexts, SENT)
    of_parent = summed(kind(parent_all, 9))
    to_contexts = kind(parent_all, 5).unionByName(to_each(of_parent, 9, context_buckets))
    both = pair_rows.cogroup(to_contexts.groupBy("to"))
    answers = both.applyInArrow(predictive, SENT)
    to_words = table_rows.unionByName(both.applyInArrow(asked_by_parts, SENT)).groupBy("to")
    replies = lexicon_rows.unionByName(asked.cogroup(to_words).applyInArrow(parent_to_chunks, SENT)).unionByName(answers)
    replies = replies.unionByName(to_each(of_parent, 9, chunks)).unionByName(to_each(counted, 8, chunks))
    names = {LONG: "long", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.float64()): "array<double>"}
    return dealt.cogroup(replies.groupBy("to")).applyInArrow(scores, ", ".join(f"{f.name} {names[f.type]}" for f in schema))


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, perplexity and base_perplexity of all tokens of each kind of document."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op6_pitman_yor(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
