"""Near-duplicates by DartMinHash signatures, banded joining and an exact check.

Each shingle of a text is an element whose weight is how often it occurs. Darts are thrown at its region, weights times
time, by hashes alone: the same darts hit the same shingle in every text. Each dart carries one of COORDINATES numbers,
and a text keeps its earliest dart of each number; two texts keep the same one with a probability equal to their
weighted Jaccard similarity. Texts that agree in all coordinates of a band meet in a bucket.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.components import HUB, components, hubs, joined
from hubflow.llm.memory import give_back, lean
from hubflow.llm.scratch import release, written
from hubflow.llm.words import GOLDEN, Words, combine, mix, runs, slices

SHINGLE, SIMILAR = 5, 0.8
#: Coordinates of a signature.
COORDINATES = 96
#: A pair of the asked similarity may share no band, and agree in fewer coordinates than are asked for, with these probabilities.
NO_BAND, TOO_FEW = 0.000004, 0.0003
#: Texts, and bytes of them, of a block that one task compares.
BLOCK, BLOCK_BYTES = 4096, 16_000_000


def banding(similar: float) -> int:
    """Coordinates of a band: as many as leave a pair of that similarity without a common band with a probability of NO_BAND at most. 4 for 0.8."""
    for rows in (8, 6, 4, 3, 2, 1):
        if (1 - similar**rows) ** (COORDINATES // rows) <= NO_BAND:
            return rows
    raise ValueError(f"signatures of {COORDINATES} coordinates are too short for a similarity of {similar}")


def agreement(similar: float) -> int:
    """In how many coordinates a pair of that similarity agrees at least, but for a probability of TOO_FEW. 62 for 0.8."""
    total = 0.0
    for n in range(COORDINATES + 1):
        total += math.comb(COORDINATES, n) * similar**n * (1 - similar) ** (COORDINATES - n)
        if total > TOO_FEW:
            return n
    return COORDINATES


class Shingles:
    """Of some texts: key (text number and 48-bit hash of a shingle, ascending) and weight; first: where each text begins. A text of fewer words than a shingle is one shingle; one without words has none."""

    def __init__(self, texts: pa.Array, n: int = SHINGLE):
        w = Words(texts)
        counts = np.diff(w.first)
        hashes, left = runs(w.hash, n), w.left()
        keep = left >= n
        text, value = w.text[keep], hashes[keep]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            begin = w.first[short]
            whole = w.hash[begin].copy()
            for i in range(1, n - 1):
                more = counts[short] > i
                whole[more] = combine(whole[more], w.hash[begin[more] + i])
            text, value = np.concatenate((text, short)), np.concatenate((value, mix(whole + np.uint64(1))))
        key = text.astype(np.uint64) << np.uint64(48) | value >> np.uint64(16)
        self.key, self.weight = np.unique(key, return_counts=True)
        self.text = (self.key >> np.uint64(48)).astype(np.int64)
        self.first = np.searchsorted(self.text, np.arange(len(counts) + 1))
        self.total = counts * 0
        np.add.at(self.total, self.text, self.weight)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.first[i], self.first[i + 1])
        return self.key[s] & np.uint64((1 << 48) - 1), self.weight[s]


def darts(shingles: Shingles, k: int = COORDINATES) -> np.ndarray:
    """Texts x k: the earliest dart of each coordinate; 0 in all of a text without shingles.

    The region of an element of weight w is cut at weights 1, 2, 4, ...; in each part darts come one after another at
    the rate of its width. They are thrown until a time by which a text has k * (log(k) + 5) of them; for the few texts
    that lack a coordinate then, until twice that time, and so on.
    """
    n = len(shingles.total)
    out = np.zeros((n, k), np.uint64)
    todo, enough = shingles.total > 0, k * (np.log(k) + 5)
    while todo.any():
        until = np.where(todo, enough / np.maximum(shingles.total, 1), 0)
        element = np.flatnonzero(todo[shingles.text])
        text, weight = shingles.text[element], shingles.weight[element]
        seed = mix((shingles.key[element] & np.uint64((1 << 48) - 1)) + np.uint64(GOLDEN))
        found_place, found_time, found_dart = [], [], []
        low, width = 0, 1
        while len(text):
            # the part of weights from low to low + width of all elements that reach into it
            at, t, s, w, number = np.zeros(len(text)), text, mix(seed + np.uint64(low)), weight, 0
            while len(t):
                number += 1
                dart = mix(s + np.uint64(number * GOLDEN % (1 << 64)))
                at = at - np.log(((dart >> np.uint64(32)).astype(float) + 0.5) / (1 << 32)) / width
                early = at <= until[t]
                at, t, s, w, dart = at[early], t[early], s[early], w[early], dart[early]
                if width > 1:
                    height = low + width * ((mix(dart) >> np.uint64(32)).astype(float) + 0.5) / (1 << 32)
                    hit = height < w
                else:
                    hit = slice(None)
                found_place.append(t[hit] * k + (dart[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64) % k)
                found_time.append(at[hit].astype(np.float32))
                found_dart.append(dart[hit])
            low += width
            width = low
            more = weight > low
            text, weight, seed = text[more], weight[more], seed[more]
        place, time, dart = map(np.concatenate, (found_place, found_time, found_dart))
        order = np.argsort(place.astype(np.uint64) << np.uint64(32) | time.view(np.uint32), kind="stable")
        place, dart = place[order], dart[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        filled = np.zeros(n * k, bool)
        filled[place[first]] = True
        done = todo & filled.reshape(n, k).all(1)
        flat = out.reshape(-1)
        keep = first & done[place // k]
        flat[place[keep]] = dart[keep] | np.uint64(1)
        todo &= ~done
        enough *= 2
    return out


def signatures(docs: DataFrame, shingle: int = SHINGLE, rows: int = 4) -> DataFrame:
    """doc_id, copy (hash of the whole text), sign (a byte of each coordinate), bands (a hash of each so many coordinates; empty without words)."""
    n_bands = COORDINATES // rows

    def signed(part: pa.RecordBatch) -> pa.RecordBatch:
        found = darts(Shingles(part["text"], shingle))
        bands = found.reshape(len(found) * n_bands, rows)
        hashes = bands[:, 0] + np.tile(np.arange(n_bands, dtype=np.uint64), len(found)) * np.uint64(GOLDEN)
        for i in range(1, rows):
            hashes = combine(hashes, bands[:, i])
        hashes = hashes.view(np.int64).reshape(-1, n_bands)
        some = found.any(1)
        sign = (found >> np.uint64(40)).astype(np.uint8)
        return pa.record_batch([part["doc_id"], part["copy"], pa.array([x.tobytes() for x in sign], pa.binary()), pa.array([h.tolist() if ok else [] for h, ok in zip(hashes, some.tolist(), strict=True)], pa.list_(pa.int64()))], names=["doc_id", "copy", "sign", "bands"])

    def compute(batches):
        for batch in batches:
            for begin, end in slices(batch["text"]):
                yield signed(batch.slice(begin, end - begin))
            give_back()

    return docs.mapInArrow(compute, "doc_id long, copy binary, sign binary, bands array<long>")


class Block:
    """Texts that are compared: by their signatures, and where texts are given by the exact weighted Jaccard similarity of those that agree enough."""

    def __init__(self, table: pa.Table, similar: float, shingle: int):
        self.similar, self.least = similar, agreement(similar)
        self.node = table["node"].to_numpy()
        self.sign = np.frombuffer(b"".join(table["sign"].to_pylist()), np.uint8).reshape(len(self.node), COORDINATES)
        self.shingles = Shingles(table["text"], shingle) if "text" in table.column_names else None
        if self.shingles:
            own, self.ids = np.unique(self.shingles.key & np.uint64((1 << 48) - 1), return_inverse=True)
            self.weight_of = np.zeros(len(own), np.int64)

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of others that are linked to x."""
        others = others[(self.sign[others] == self.sign[x]).sum(1) >= self.least]
        s = self.shingles
        if s is None or not len(others):
            return others
        own = slice(s.first[x], s.first[x + 1])
        self.weight_of[self.ids[own]] = s.weight[own]
        size = s.first[others + 1] - s.first[others]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(s.first[others] - ends + size, size)
        common = np.diff(np.concatenate(([0], np.cumsum(np.minimum(s.weight[at], self.weight_of[self.ids[at]]))))[np.concatenate(([0], ends))])
        self.weight_of[self.ids[own]] = 0
        return others[common >= self.similar * (s.total[x] + s.total[others] - common) - 1e-9]

    def forest(self) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Links that connect all that is linked, and the first text of each one's group: a text that is reached isn't compared again, but from it are those not reached yet."""
        left, out, root = np.arange(len(self.node)), [], np.arange(len(self.node))
        while len(left):
            first, left = int(left[0]), left[1:]
            queue = [first]
            while queue and len(left):
                x = queue.pop()
                near = self.near(x, left)
                root[near] = first
                out += [(x, y) for y in near.tolist()]
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
        return out, root

    def bridges(self, label: np.ndarray, outside: np.ndarray) -> list[tuple[int, int]]:
        """Links of texts that stand outside of the largest group with those of other labels; two labels that are linked are one from then on."""
        label, out = label.copy(), []
        for x in np.flatnonzero(outside).tolist():
            while len(near := self.near(x, np.flatnonzero(label != label[x]))):
                out.append((x, int(near[0])))
                label[label == label[near[0]]] = label[x]
        return out


MADE = "kind int, grp long, a long, b long"
LINK, MEMBER = 0, 1


def made(kind: list[int], grp: list[int], a: list[int], b: list[int]) -> pa.Table:
    return pa.table([pa.array(kind, pa.int32()), *(pa.array(x, pa.int64()) for x in (grp, a, b))], names=["kind", "grp", "a", "b"])


def connect(items: DataFrame, similar: float, shingle: int, block: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links a, b between nodes that connect, within each group of items (grp, node, sign, size and maybe text), all that is linked there.

    A group of over block rows, or block_bytes of size, is cut into tiles by hash. Each tile is connected within itself; then the first
    of each tile's parts are connected with each other; what still stands outside of a group's largest part is compared with the
    other tiles, block by block. So copies of one text cost a row each, and no task holds more than two blocks.
    """
    names = [c for c in ("node", "sign", "text") if c in items.columns]
    large = items.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    tiles = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes))
    large = written(large.select("grp", tiles.cast("int").alias("tiles")).where("tiles > 1"), "large-groups")
    bins = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), items.count() // 500)
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    cut = items.join(large, "grp", "left").withColumn("tile", F.coalesce(tile, F.lit(-1)))
    where = F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("grp"), F.lit(bins))).otherwise(F.xxhash64("grp", "tile"))

    def groups(table: pa.Table, by: tuple[str, ...]):
        """Tables of equal values of by, each node once."""
        keys = [table[c].to_numpy() for c in (*by, "node")]
        order = np.lexsort(keys[::-1])
        keys = np.column_stack([k[order] for k in keys])
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]).any(1)
        table, keys = table.take(order[once]), keys[once]
        ends = np.flatnonzero(np.concatenate(([True], (keys[1:, :-1] != keys[:-1, :-1]).any(1), [True])))
        for b, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield table.slice(b, e - b)

    def inside(table: pa.Table) -> pa.Table:
        out: tuple[list[int], ...] = ([], [], [], [])

        def add(kind, grp, a, b):
            for x, v in zip(out, (kind, grp, a, b), strict=True):
                x.append(v)

        for part in groups(table, ("grp", "tile")):
            grp, of = part["grp"][0].as_py(), Block(part, similar, shingle)
            links, root = of.forest()
            for x, y in links:
                add(LINK, grp, int(of.node[x]), int(of.node[y]))
            if part["tile"][0].as_py() >= 0:
                for x, r in enumerate(root.tolist()):
                    add(MEMBER, grp, int(of.node[x]), int(of.node[r]))
        return made(*out)

    within = written(cut.select(where.alias("bin"), "grp", "tile", *names).groupBy("bin").applyInArrow(lean(inside), MADE), "links")
    links = within.where(F.col("kind") == LINK).select("a", "b")
    if large.isEmpty():
        return links
    members = within.where(F.col("kind") == MEMBER).select("grp", F.col("a").alias("node"), F.col("b").alias("root"))
    roots = members.where("node = root").select("grp", "node")
    few = roots.groupBy("grp").count().where(F.col("count") <= block).select("grp")
    tops = items.select("grp", *names).join(roots, ["grp", "node"]).join(few, "grp").withColumn("tile", F.lit(0))
    between = written(tops.withColumn("bin", F.pmod(F.xxhash64("grp"), F.lit(bins))).groupBy("bin").applyInArrow(lean(inside), MADE), "links")
    links = links.unionByName(between.where(F.col("kind") == LINK).select("a", "b"))
    label = between.where(F.col("kind") == MEMBER).select("grp", F.col("a").alias("root"), F.col("b").alias("label"))
    members = written(members.join(label, ["grp", "root"], "left").select("grp", "node", F.coalesce("label", "root").alias("label")), "members")
    sizes = members.groupBy("grp", "label").count()
    largest = sizes.groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("largest"), (F.sum("count") - F.max("count")).alias("outside")).where("outside > 0")
    open_groups = written(largest.join(large, "grp"), "open-groups")
    if open_groups.isEmpty():
        return links
    slices = F.ceil(F.col("outside") / block).cast("int")
    rest = cut.select("grp", "tile", *names).join(members.join(open_groups, "grp").withColumn("slices", slices), ["grp", "node"])
    stands_outside = F.col("label") != F.col("largest")
    at_home = rest.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("outside", F.lit(False))
    visiting = rest.where(stands_outside).withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int")).withColumn("from", F.col("tile"))
    visiting = visiting.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("tile != from").withColumn("outside", F.lit(True))
    columns = ["grp", "tile", "slice", "label", "outside", *names]

    def across(table: pa.Table) -> pa.Table:
        of = Block(table, similar, shingle)
        found = of.bridges(table["label"].to_numpy(), table["outside"].to_numpy(zero_copy_only=False))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(of.node[list(x)], pa.int64()) for x in (a, b)], names=["a", "b"])

    bridges = at_home.select(columns).unionByName(visiting.select(columns)).groupBy("grp", "tile", "slice").applyInArrow(lean(across), "a long, b long")
    return links.unionByName(bridges)


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id for each row of docs (doc_id, text, ...): the smallest doc_id among all documents that it is linked to, directly or through others.

    Linked are equal texts, and texts whose shingles (of so many words, each as often as it occurs) have at least that
    weighted Jaccard similarity. A null text counts as empty; texts without words are linked to equal ones only; one of
    fewer words than a shingle is a shingle. Rows with a null doc_id stay alone (class_id null). Rows of one doc_id are
    one document: its class holds what any of its texts is linked to. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = docs.where("doc_id is not null").withColumn("copy", F.unhex(F.md5("text")))
    signed = written(signatures(known, shingle, banding(similar)), "signatures")
    # equal texts first: of each only one goes on, under a number of its own
    one = signed.groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    texts = written(one.withColumn("node", F.monotonically_increasing_id()), "texts")
    of_docs = written(signed.select("doc_id", "copy").join(texts.select("copy", "node"), "copy").select("doc_id", "node"), "texts-of-documents")

    buckets = texts.select("node", F.explode("bands").alias("grp"))
    shared = buckets.withColumn("n", F.count("*").over(Window.partitionBy("grp"))).where("n > 1").drop("n")
    met = written(shared.join(texts.select("node", "sign"), "node").withColumn("size", F.lit(COORDINATES)), "buckets")
    likely = components(connect(met, similar, shingle, block))
    release(met)
    members = likely.join(texts.select("node", "doc_id", "copy", "sign"), "node").select(F.col("component").alias("grp"), "node", "doc_id", "copy", "sign")
    first = F.row_number().over(Window.partitionBy("doc_id", "copy").orderBy(F.lit(0)))  # of repeated rows
    whole = known.withColumn("n", first).where("n = 1").select("doc_id", "copy", "text")
    items = members.join(whole, ["doc_id", "copy"]).select("grp", "node", "sign", F.octet_length("text").alias("size"), "text")
    exact = connect(written(items, "likely-copies"), similar, shingle, block)
    least = F.min("node").over(Window.partitionBy("doc_id"))
    same = of_docs.withColumn("least", least).where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    groups = components(exact.unionByName(same))
    classes = groups.join(texts.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    class_of = groups.join(classes, "component").select("node", "class_id")
    alone = texts.select("node", "doc_id").join(class_of, "node", "left").select("node", F.coalesce("class_id", "doc_id").alias("class_id"))
    alone = alone.withColumnRenamed("node", "its")
    out = joined(of_docs, "node", "doc_id", alone, "its", hubs(of_docs, "node", HUB)).select("doc_id", "class_id")
    return out.unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id")))


def op4_dart_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, by brute force; classes by transitive closure.
OP4_SQL = r"""
    WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS doc_id FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
    w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
    p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM w),
    s AS (SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle, count(*) AS n FROM p GROUP BY ALL),
    z AS (SELECT doc_id, sum(n) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT c.a, c.b FROM c JOIN z x ON x.doc_id = c.a JOIN z y ON y.doc_id = c.b WHERE c.n >= 0.8 * (x.n + y.n - c.n)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    m AS (SELECT doc_id AS node, doc_id AS seen FROM t UNION SELECT m.node, e.b FROM m JOIN e ON e.a = m.seen),
    k AS (SELECT node, min(seen) AS class_id FROM m GROUP BY node)
    SELECT d.doc_id, k.class_id FROM documents d LEFT JOIN t ON t.text = coalesce(d.text, '') LEFT JOIN k ON k.node = t.doc_id AND d.doc_id IS NOT NULL"""
