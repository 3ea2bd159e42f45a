import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from hubflow.llm import matroska, mixing, quality, substring_dedup, top_k, words
from hubflow.llm.substring_dedup import remove_repeats


def brute_repeats(docs, window):
    """{(doc_id, kept text)} by looking at every window, in order of doc_id."""
    seen, out = set(), []
    for doc_id, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            k = tuple(words[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out.append((doc_id, b" ".join(w for w, g in zip(words, gone) if not g).decode(), len(words), sum(gone)))
    return out


@pytest.mark.parametrize("window, base", [(2, 10), (3, 10), (7, 1), (7, 2), (20, 10), (20, 5), (21, 2)])
def test_repeats_against_every_window(spark, window, base):
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(120):
        words = [rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            a = rng.randint(0, 30)
            words[5:5] = passage[a : a + rng.randint(5, 30)] * rng.randint(1, 2)
        docs.append((i, " ".join(words) if i % 17 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5, "doc_id")
    got = sorted((r.doc_id, r.kept, r.n_words, r.n_removed) for r in remove_repeats(df, window, 1500, base=base).collect())
    assert got == sorted(brute_repeats(docs, window))


def test_levels():
    assert substring_dedup.levels(20) == [10, 20] and substring_dedup.levels(50) == [12, 25, 50] and substring_dedup.levels(160) == [10, 20, 40, 80, 160]
    assert substring_dedup.levels(2) == [1, 2] and substring_dedup.levels(21, 2) == [2, 5, 10, 21]


def test_repeats_of_odd_rows(odd, clashing, empty):
    for df in (odd, clashing):
        rows = remove_repeats(df).collect()
        assert len(rows) == 9
        by = defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
        assert by[2][0].kept == by[3][0].kept == by[4][0].kept == ""
        assert by[6][0].n_removed == 2980 + 19 and by[None][0].n_removed == 0
    assert remove_repeats(empty).count() == 0


def test_repeated_rows_count_one_after_the_other(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (5, "x " + text), (None, text), (None, text), (9, "")], "doc_id long, text string")
    for chunk_bytes in (10, 10**6):
        got = sorted((r.doc_id is None, r.n_removed) for r in remove_repeats(docs, chunk_bytes=chunk_bytes).collect())
        assert got == [(False, 0), (False, 0), (False, 30), (False, 30), (True, 30), (True, 30)]


def test_words_made_to_collide():
    """A string and its complement, each made by doubling, have equal sums of powers modulo 2 ** 64."""
    one, two = "a", "b"
    for _ in range(11):
        one, two = one + two, two + one
    found = words.Words(pa.array([one, two, one[:64], two[:64], "A" * 70, "a" * 70, one]))
    assert len(set(found.hash.tolist())) == 6 and found.hash[0] == found.hash[6]
    low = words.Words(pa.array(["A" * 70, "a" * 70, "AbC", "abc"]), lower=True).hash
    assert low[0] == low[1] and low[2] == low[3]


def test_matroska_lacing():
    for n in (1, 2, 64, 65, 1024, 1025, 3000):
        for kind in (matroska.XIPH, matroska.FIXED, matroska.VARIABLE):
            payload = os.urandom(192 * n)
            file = matroska.audio_file(payload, kind)
            found = matroska.packets(file)
            assert b"".join(file[p[2] : p[3]] for p in found) == payload
            assert len(found) == n and found[0][6] and found[-1][1] <= 192 * n * 125_000
    rng = random.Random(1)
    for kind in (matroska.XIPH, matroska.VARIABLE):
        for _ in range(50):
            frames = [os.urandom(rng.choice([0, 1, 254, 255, 256, 600, 20000])) for _ in range(rng.randint(2, 20))]
            block = matroska.lace(frames, kind)
            assert [block[a:b] for a, b in matroska.laced(block, 0, len(block), kind)] == frames


def test_matroska_elements_of_unknown_size():
    """A live file: segment and clusters of unknown size, blocks in groups, two tracks, void elements between."""
    e, num = matroska.element, matroska.number
    block = lambda t, at, x: matroska.write_size(t) + at.to_bytes(2, signed=True) + b"\0" + x
    open_end = lambda name, body: name.to_bytes(4) + b"\x01" + b"\xff" * 7 + body
    one = open_end(matroska.CLUSTER, num(matroska.TIMESTAMP, 100) + e(matroska.GROUP, e(matroska.BLOCK, block(1, -5, b"abc"))) + e(0xEC, b"\0" * 9))
    two = open_end(matroska.CLUSTER, num(matroska.TIMESTAMP, 300) + e(matroska.SIMPLE, block(200, 7, b"defg")))
    file = e(matroska.EBML, b"") + open_end(matroska.SEGMENT, e(matroska.INFO, num(matroska.SCALE, 2_000_000)) + one + two)
    found = matroska.packets(file)
    assert [(p[0], p[1], file[p[2] : p[3]], p[4]) for p in found] == [(1, 190_000_000, b"abc", True), (200, 614_000_000, b"defg", False)]


def test_matroska_keyframes_and_what_ends_a_cluster():
    """Groups with a reference before or behind their block hold no keyframe; tags end a cluster of unknown size."""
    e, num = matroska.element, matroska.number
    block = lambda x: e(matroska.BLOCK, matroska.write_size(1) + bytes(3) + x)
    back = e(matroska.REFERENCE, b"\xff")
    groups = [e(matroska.GROUP, x) for x in (block(b"key"), block(b"later") + back, back + block(b"too"), block(b"key again"))]
    simple = [e(matroska.SIMPLE, matroska.write_size(1) + bytes([0, 0, f]) + b"s") for f in (0, 128)]
    for name in (matroska.TAGS, matroska.CHAPTERS, matroska.ATTACHMENTS, matroska.SEEK_HEAD):
        cluster = matroska.CLUSTER.to_bytes(4) + b"\x01" + b"\xff" * 7 + num(matroska.TIMESTAMP, 5) + b"".join(groups + simple)
        found = matroska.packets(e(matroska.EBML, b"") + e(matroska.SEGMENT, cluster + e(name, b"\x80" * 3) + e(matroska.CLUSTER, num(matroska.TIMESTAMP, 9) + groups[1])))
        assert [p[4] for p in found] == [True, False, False, True, False, True, False]
        assert [p[1] for p in found] == [5_000_000] * 6 + [9_000_000]


def test_matroska_query(spark, sf_dir, odd, clashing, empty):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = matroska.op2_matroska(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id].encode()
        payload = text + b" " * (-len(text) % 192 or 0 if text else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    for df in (odd, clashing):
        assert sorted(r.payload_bytes for r in matroska.features(matroska.store_texts(df)).collect())[:7] == [192] * 7
    assert matroska.features(matroska.store_texts(empty)).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"\x1a\x45")), (2, None), (3, bytearray())], "doc_id long, media binary")
    assert [(r.doc_id, r.track, bool(r.error)) for r in matroska.packet_table(bad).collect()] == [(1, None, True)]
    table = matroska.packet_table(matroska.store_texts(odd))
    assert table.groupBy("doc_id").count().count() == 8 and table.where("error is not null").count() == 0


def brute_top(rows, ask, k):
    """[(query_id, rank, vec_id, score)] of every query row by all inner products; rows: (vec_id, vector) by place."""
    out, width = [], max((len(v) for _, v in rows), default=0)
    x = np.array([[*v, *[0] * (width - len(v))] for _, v in rows], float).reshape(len(rows), width)
    for i, (q, _) in enumerate(rows):
        if ask(q):
            best = sorted((-int(s), rows[j][0]) for j, s in enumerate(x @ x[i]) if j != i)[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_values, regions", [(1 << 21, 1024), (1000, 8), (1000, 1), (400, 1024)])
def test_top_k(spark, shard_values, regions):
    """Clustered vectors, a third of all rows equal, repeated ids, shorter and empty vectors, in one shard, many or a region of many."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-6, 7, 5) + (i % 4) * 9).tolist()) for i in range(700)] + [(i, [1, 2, 3, 4, 5]) for i in range(700, 1200)]
    rows += [(50, [1, 1, 1, 1, 1]), (50, [30, 1, 1, 1, 1]), (7, [2, 3])] + [(i, []) for i in range(2000, 2100)]
    df = spark.createDataFrame([*rows, (None, [1] * 5), (2000, None)], "vec_id long, v array<long>").withColumns({c: F.lit(1) for c in ("rank", "row", "shard", "region")})
    got = sorted(tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_values, regions).collect())
    assert got == brute_top(rows, lambda q: q % 50 == 0, 5)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1])], "vec_id long, v array<long>")
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1]), (50, [2, 1])], "vec_id long, v array<long>")
    assert sorted(map(tuple, top_k.top_k(few, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 50, 2), (50, 1, 0, 2)]


def test_vectors_that_take_no_part(spark, tmp_path):
    bad = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [0.0, float("-inf")]]
    good = [(i * 50, [i / 7 - 0.3, 0.5 - i / 9]) for i in range(6)] + [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (0, [-0.9, 0.4])]
    rows = [(i, v, 0) for i, v in good] + [(i * 50, v, 0) for i, v in enumerate(bad)] + [(None, [1.0, 1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int).tolist()) for i, v in good]
    assert sorted(map(tuple, top_k.op9_kd_tree_top_k(spark, str(tmp_path)).collect())) == brute_top(whole, lambda q: q % 50 == 0, 5)


def test_boxes_keep_queries_from_far_regions():
    """Vectors in clusters: a query's bound to the boxes of other clusters is under its kth score."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-300, 300, (64, 16))
    x = (np.repeat(centres, 200, 0) + rng.integers(-20, 21, (12_800, 16))).astype(float)
    of = top_k.Regions(x[::4], 64).of(x)
    boxes = [(x[of == r].min(0), x[of == r].max(0)) for r in np.unique(of)]
    queries = x[::50]
    kth = np.sort(queries @ x.T, 1)[:, -6]
    sent = (top_k.upper_bounds(queries, *map(np.array, zip(*boxes))) >= kth[:, None]).mean()
    assert sent < 0.1


def test_levels_of_targets(spark):
    sizes = spark.createDataFrame([(str(i), str(i), n, 1) for i, n in enumerate([10, 1000, 30, 0, 400, 77])], "key string, source string, size long, n long")
    got = {r.key: r.target for r in mixing.targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    words, weight = {str(i): n for i, n in enumerate([10, 1000, 30, 0, 400, 77])}, {str(i): (3, 1, 2)[i % 3] for i in range(6)}
    goal, fixed = 1.5 * sum(words.values()), {}
    while True:
        free = [k for k in words if k not in fixed]
        rest = goal - sum(fixed.values())
        now = {k: rest * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if now[k] > 2 * words[k]]
        if not over:
            break
        fixed |= {k: 2.0 * words[k] for k in over}
    assert got == pytest.approx(fixed | now)


def test_fit():
    assert (mixing.fit(np.array([5, 7]), np.array([2, 2]), 14, 1) * [5, 7]).sum() == 14
    rng = np.random.default_rng(5)
    for _ in range(300):
        size = np.unique(rng.integers(0, 60, rng.integers(1, 20)))
        count = rng.integers(1, 6, len(size))
        budget = int(rng.integers(0, (size * count).sum() + 2))
        take = mixing.fit(size, count, budget, 1)
        assert (take >= 0).all() and (take <= count).all()
        sums = {0}
        for s, c in zip(size.tolist(), count.tolist()):
            sums = {a + s * k for a in sums for k in range(c + 1)}
        assert (size * take).sum() == max(s for s in sums if s <= budget)
    size, count = np.arange(1, 3000), np.full(2999, 9)
    for budget in (0, 1, 65_537, 1_000_003, 30_000_000):
        assert (mixing.fit(size, count, budget, 1) * size).sum() == budget
    # beyond the words that are looked at: sums are hit, few large sizes come as near as one of them
    for _ in range(50):
        size = np.unique(rng.integers(1, 400, 60))
        count = rng.integers(1, 300, len(size))
        budget = int(rng.integers(5000, (size * count).sum() - 5000))
        take = mixing.fit(size, count, budget, 2, 4096)
        assert (take >= 0).all() and (take <= count).all() and (take * size).sum() == budget
    take = mixing.fit(np.array([10_000]), np.array([50]), 123_456, 1, 4096)
    assert take.tolist() == [12]


def test_fit_of_long_documents():
    """Sums that only giving many of one size and taking back many of another can hit, far beyond any one size."""
    for size, count, budget, best in (
        ([150_000, 170_000, 210_000], [5, 5, 5], 1_000_000, 1_000_000),
        ([100_001, 100_003, 99_999], [10, 10, 10], 1_400_007, 1_400_006),
        ([3_000_000, 5_000_000], [40, 40], 101_000_000, 101_000_000),
    ):
        take = mixing.fit(np.array(size), np.array(count), budget, 8)
        assert (take * size).sum() == best and (take <= count).all() and (take >= 0).all()
    rng = np.random.default_rng(11)
    for _ in range(25):
        size = np.unique(rng.integers(20_000, 200_000, rng.integers(2, 6)))
        count = rng.integers(1, 6, len(size))
        budget = int(rng.integers(1, (size * count).sum()))
        take = mixing.fit(size, count, budget, 3)
        sums = {0}
        for s, c in zip(size.tolist(), count.tolist()):
            sums = {a + s * k for a in sums for k in range(c + 1)}
        assert (take >= 0).all() and (take <= count).all() and (take * size).sum() == max(s for s in sums if s <= budget)


def test_mixing(spark, sf_dir, odd, clashing, empty):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = mixing.op8_mixing(spark, sf_dir).collect()
    again = {r.doc_id: r.taken for r in mixing.op8_mixing(spark, sf_dir).collect()}
    taken, goal = defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(docs[r.doc_id].text.encode().split())
        assert r.taken in (0, r["size"], 2 * r["size"]) and again[r.doc_id] == r.taken
        taken[docs[r.doc_id].source] += r.taken
        goal[docs[r.doc_id].source] = r.target
    assert len(rows) == len(docs)
    assert all(abs(taken[s] - goal[s]) <= 3 for s in goal)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(len(d.text.encode().split()) for d in docs.values()))
    for df in (odd, clashing):
        out = mixing.mix(df, keep=("text", "source"))
        assert out.count() == 9 and {"text", "source"} <= set(out.columns)
    assert mixing.mix(empty).count() == 0


def test_large_groups_of_one_length_are_cut_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ORDERED", 50)
    df = spark.range(1000).selectExpr("id AS doc_id", "'a b c' AS text", "'s' AS source").unionByName(spark.range(1000, 1300).selectExpr("id AS doc_id", "'a b' AS text", "'t' AS source"))
    rows = mixing.mix(df).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 3 for r in rows)


def test_quality_on_held_out_labels(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in quality.op10_quality(spark, sf_dir).collect()]
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    asked = [r for r in rows if r.held_out and r.doc_id in labels]
    right = [r.predicted == labels[r.doc_id] for r in asked]
    assert sum(right) / len(right) > 0.85


def test_quality_of_odd_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0), (99, 0, 0), (5, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for df in (odd, clashing):
        model = quality.fit(df, labels)
        out = quality.scored(df, model)
        assert out.count() == 9 and out.where("score is null or score < 0 or score > 1").count() == 0
        assert sorted(out.columns) == sorted({*df.columns, "score"})
    assert quality.scored(empty, quality.fit(empty, labels.limit(0))).count() == 0
    assert {r.score for r in quality.scored(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}


def test_scores_against_a_plain_loop(spark, sf_dir):
    """Sizes of all pieces with either dictionary, the curve through them, and a calibration whose weighted gradient is zero."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    long = spark.createDataFrame([(10**6, "lorem ipsum dolor sit amet " * 4000), (10**6 + 1, ""), (10**6 + 2, None)], "doc_id long, text string")
    docs = docs.unionByName(long)
    model = quality.fit(docs, labels)
    assert model.trained == (True, True)

    def difference(text):
        sizes = []
        for data in (model.good, model.bad):
            total = 0
            raw = (text or "").encode()
            while raw:
                piece, raw = raw[:2048], raw[2048:]
                total += len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_dict_id=False).compress(piece))
            sizes.append(total)
        return (sizes[1] - sizes[0]) / max(*sizes, 1)

    some = [r for r in docs.orderBy(F.xxhash64("doc_id")).limit(150).collect()] + long.collect()
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    for r in some:
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(model.slope * difference(r.text) + model.offset))), abs=1e-9)
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 0.02, 500), rng.random(500) < 0.7
    x = x + 0.01 * y
    slope, offset = quality.calibrate(x, y.astype(float))
    p, w = 1 / (1 + np.exp(-(slope * x + offset))), np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    assert slope > 0 and abs((w * (y - p)).sum()) < 0.05 and abs((w * (y - p) * x).sum()) < 0.05 * np.abs(x).mean()


def test_few_labels_give_dictionaries_of_the_pieces_themselves(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "zzz qqq xxx ") * 3) for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    model = quality.fit(docs, labels)
    assert model.trained[0] is False and b"good words" in model.good
    assert quality.dictionary([b"ab", b"c"]) == (b"abc", False) and quality.dictionary([]) == (b"", False)
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in quality.scored(docs, model).collect())


def test_pieces_come_from_all_of_a_long_text(spark):
    text = "".join(f"{i:08d}" for i in range(100_000))
    docs = spark.createDataFrame([(1, 0, text), (2, 1, "short"), (3, 1, "")], "doc_id long, quality int, text string")
    rows = quality.sampled_pieces(docs, 8).collect()
    places = sorted(r.place for r in rows if r.doc_id == 1)
    assert len(places) == 8 and max(places) > 400_000 and all(p % 2048 == 0 for p in places)
    assert [bytes(r.piece) for r in rows if r.doc_id != 1] == [b"short"]
