from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from hubflow.llm.scratch import written
from test_near_dedup import brute_classes
from test_others import brute_repeats


@pytest.fixture(scope="module")
def states(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), name))
    return out


#: Nulls in every column, repeated rows, and a doc_id of two texts.
ROWS = [
    (1, "one two three four five six", "en", "a", 27),
    (1, "one two three four five six", "en", "a", 27),
    (1, "another text of the same document", "en", "a", 33),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "no id here", None, None, 5),
    (None, "no id here", None, None, 5),
    (None, None, None, None, None),
    (4, "word " * 3000, "en", "a", 15000),
]


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(states):
    assert all(tuple(s.columns) == C.COLUMNS for s in states[:-1])


def test_quality_keeps_good_documents(spark, sf_dir, states):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {d for d, _ in texts(states[1])}
    good, bad = ([d in kept for d, q in labels.items() if q == x] for x in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.25


def test_one_of_each_group_stays(states):
    classes = brute_classes(texts(states[1]))
    assert sorted(d for d, _ in texts(states[2])) == sorted(set(classes.values()))


def test_passages_stay_once(states):
    before = texts(states[2])
    expected = {d: (kept, removed) for d, kept, _, removed in brute_repeats(sorted(before), C.PASSAGE)}
    given = dict(before)
    assert dict(texts(states[3])) == {d: kept if removed else given[d] for d, (kept, removed) in expected.items()}


def test_copies_of_the_mix(states):
    size = lambda t: len(t.encode().split())
    given = {r.doc_id: r for r in states[3].collect()}
    copies = Counter(r.doc_id for r in states[4].collect())
    assert max(copies.values()) <= 2
    total, taken = defaultdict(int), defaultdict(int)
    for d, r in given.items():
        total[r.source] += size(r.text)
        taken[r.source] += size(r.text) * copies[d]
    assert abs(sum(taken.values()) - 1.5 * sum(total.values())) <= 3 * len(total)
    assert all(t <= 2 * total[s] for s, t in taken.items())


def test_sequences_hold_the_mix(states):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for d, t in texts(states[4]):
        expected.update([(d, i) for i in tokenizer.encode(t, add_special_tokens=False).ids + [C.END_OF_TEXT]])
    got, places = Counter(), []
    for r in states[5].collect():
        ids = np.frombuffer(r.ids, "<u2").tolist()
        got.update([(r.doc_id, i) for i in ids])
        places.append((r.sequence_id * 4096 + r.offset, len(ids)))
    assert got == expected
    places.sort()
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


@pytest.fixture(scope="module")
def odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(1) for c in ("key", "copy", "place", "size", "row", "chunk", "node", "score", "copies")})


def test_near_duplicates_of_odd_rows(spark, sf_dir, odd_rows):
    rows = [sorted((r.doc_id or -1, r.text or "") for r in C.near_dedup(spark, odd_rows, sf_dir).collect()) for _ in range(2)]
    # of the two texts of document 1 always the same stays; an empty and a missing text are copies; rows without id stay
    assert rows[0] == rows[1] and [d for d, _ in rows[0]] == [-1, -1, -1, 1, 2, 4]


def test_passages_of_odd_rows(spark, sf_dir, odd_rows):
    out = C.substring_dedup(spark, odd_rows, sf_dir)
    assert tuple(out.columns) == C.COLUMNS and out.count() == len(ROWS)
    assert {len(r.text.split()) for r in out.where("doc_id = 4").collect()} == {1}


def test_mixing_of_odd_rows(spark, sf_dir, odd_rows):
    rows = C.mixing(spark, odd_rows, sf_dir).collect()
    given = Counter((d, t, s) for d, t, _, s, _ in ROWS)
    taken = Counter((r.doc_id, r.text, r.source) for r in rows)
    assert taken.keys() <= given.keys() and all(n <= 2 * given[k] for k, n in taken.items())
    words = lambda c: sum(n * len((k[1] or "").split()) for k, n in c.items())
    assert abs(words(taken) - 1.5 * words(given)) <= 3000  # the words of the longest document
    assert sorted(map(str, C.mixing(spark, odd_rows, sf_dir).collect())) == sorted(map(str, rows))


def test_quality_and_packing_of_odd_rows(spark, sf_dir, odd_rows):
    kept = C.quality(spark, odd_rows, sf_dir)
    assert tuple(kept.columns) == C.COLUMNS and kept.count() <= len(ROWS)
    pieces = C.packing(spark, odd_rows, sf_dir).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(d for d, *_ in ROWS)


def test_stages_of_no_documents(spark, sf_dir, odd_rows):
    for name, stage in C.STAGES:
        assert stage(spark, odd_rows.limit(0), sf_dir).count() == 0, name
