import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hubflow.llm import near_dedup
from hubflow.llm.components import components


def shingles(text, n=5):
    w = (text or "").encode().split()
    if 0 < len(w) < n:
        return Counter([tuple(w)])
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute_classes(docs, similar=0.8):
    """{doc_id: smallest doc_id linked to it}, by comparing all pairs that share a shingle."""
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    texts, sets, by = {}, {}, defaultdict(list)
    for d, t in docs:
        if (t or "") in texts:
            join(d, texts[t or ""])
            continue
        texts[t or ""] = d
        sets[d] = shingles(t)
        for s in sets[d]:
            by[s].append(d)
    for d, s in sets.items():
        for o in {x for k in s for x in by[k] if x < d}:
            common = sum((s & sets[o]).values())
            if common and common / (sum(s.values()) + sum(sets[o].values()) - common) >= similar:
                join(d, o)
    return {d: find(d) for d, _ in docs}


def test_classes_against_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in near_dedup.op4_dart_minhash(spark, sf_dir).collect()}
    assert got == brute_classes(docs)


def mutated(n, seed=3, most=9):
    """Copies at all distances of one text, and other texts."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    return docs + [(n + i, " ".join(f"{i}y{j}" for j in range(30))) for i in range(50)]


@pytest.mark.parametrize("block", [20, 50, 1500])
def test_large_group_in_several_blocks(spark, block):
    docs = mutated(300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute_classes(docs)
    assert 10 < len(set(expected.values())) < 250
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df, block=block).collect()} == expected


def test_other_similarities(spark):
    assert (near_dedup.banding(0.8), near_dedup.agreement(0.8)) == (4, 62)
    docs = mutated(120, most=20)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for similar in (0.6, 0.95):
        assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df, similar).collect()} == brute_classes(docs, similar)
    with pytest.raises(ValueError):
        near_dedup.banding(0.05)


def test_every_text_of_a_document_counts(spark):
    """doc_id 1 has two texts, each linked to another document; rows are repeated."""
    one, two = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    near = lambda x: " ".join([*x[:59], "z"])
    docs = [(1, " ".join(one)), (1, " ".join(two)), (1, " ".join(two)), (5, near(one)), (6, near(two)), (6, near(two)), (7, "c"), (0, " ".join(f"d{i}" for i in range(9)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(df).collect()) == [(0, 0), (1, 1), (1, 1), (1, 1), (5, 1), (6, 1), (6, 1), (7, 7)]


@pytest.mark.parametrize("frame", ["odd", "clashing"])
def test_odd_rows(frame, request):
    rows = near_dedup.near_duplicates(request.getfixturevalue(frame)).collect()
    assert sorted((r.doc_id or -1, -1 if r.class_id is None else r.class_id) for r in rows) == [(-1, -1), (1, 1), (1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (6, 6), (7, 7)]


def test_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_equal_coordinates_estimate_weighted_jaccard():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[40:]), " ".join(words[:200] * 3), " ".join(words[:200] * 2), "a b", "a b c"]
    found = near_dedup.darts(near_dedup.Shingles(pa.array(texts)), 4096)
    for i in range(6):
        for j in range(i):
            a, b = shingles(texts[i]), shingles(texts[j])
            common = sum((a & b).values())
            assert abs((found[i] == found[j]).mean() - common / (sum(a.values()) + sum(b.values()) - common)) < 0.04
    assert (found != 0).all() and rng


@pytest.mark.parametrize("hub", [5, 100_000])
def test_components(spark, hub):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    links += [(2000, 2001 + i) for i in range(60)]
    parent |= {2000 + i: 2000 for i in range(61)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), hub).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}
