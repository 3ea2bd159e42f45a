import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hubflow.llm import huffman, packing, tokens
from hubflow.llm.token_counts import LAST, Automaton, automaton, count_tokens, op3_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.read_tokenizer(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(docs, end):
    t = Tokenizer.from_file(PATH)
    return [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in docs.collect()]


def test_pieces_of_packing_hold_each_id_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = dict(encoded(docs, 2))
    rows = packing.op5_packing(spark, sf_dir).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == expected.keys()
    for doc, ids in expected.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or number == len(by_sequence) - 1


def test_token_files_give_back_all_ids(spark, sf_dir):
    expected = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id"), 1)
    got = {r.doc_id: r for r in huffman.op7_huffman_token_files(spark, sf_dir).collect()}
    at = 0
    for doc, ids in expected:
        r = got.pop(doc)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not got


@pytest.mark.parametrize("frame", ["odd", "clashing", "empty"])
def test_odd_rows(frame, request, tokenizer):
    docs = request.getfixturevalue(frame)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    expected = sorted(((d, crc(i)) for d, i in encoded(docs, 1)), key=key)
    files = huffman.read_files(huffman.write_files(docs, tokenizer, 1)).collect()
    assert sorted(((r.doc_id, r.ids_crc32) for r in files), key=key) == expected
    ends = sorted((r.start, r.start + r.n_tokens) for r in files)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    pieces = packing.pack(docs, tokenizer, 2, 50).collect()
    assert sum(r.length for r in pieces) == sum(len(i) for _, i in encoded(docs, 2))
    places = sorted((r.sequence_id * 50 + r.offset, r.length) for r in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


#: What splitting and normalizing treat apart: marks, contractions, digits, white space, combining marks, capitals without a lower case of one character, special tokens.
ODDITIES = [*"abzAZK019.,!?-_=@'\u2019|<>`^ \n", " ", " ", "\n", "\t", "\r\n", "\x00", "\x1c", "\x85", "\xa0", "\u2003", "\u0301", "\u0338", "\u0331", "H\u0331", "=\u0338", "\u212a", "\u0130", "\u03a3", "\u00c9", "\u00e9", "\u00df", "\u017f", "\u0149", "\u00aa", "\u00b2", "\u0661", "\u2014", "\u6f22", "\U0001f600", "'s", "'LL", "'re", "<|endoftext|>", "<|ENDOFTEXT|>", "the", "Hand", "word"]


def test_ids_are_the_tokenizers(tokenizer, monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(ODDITIES, rng.integers(0, 30))) for _ in range(4000)] + ["", " ", "\n", "", "a", ".", "a."]
    t = Tokenizer.from_file(PATH)
    expected = [np.array(t.encode(x, add_special_tokens=False).ids + [7], "<u2").tobytes() for x in texts]
    rows = pa.array(["before", *texts]).slice(1)
    # all at once, in many parts, and while nearly all is forgotten
    for most, remembered in ((1 << 30, 10_000_000), (500, 10_000_000), (500, 500), (1, 500)):
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        ids = tokens.Ids(tokenizer)
        for some in (rows, rows.cast(pa.large_string())):
            assert ids.encode(some, np.array([7], "<u2").tobytes(), most).to_pylist() == expected
        assert ids.encode(rows.slice(0, 0)).to_pylist() == []
        if remembered == 500:
            # what was asked for before, since then, and by one part
            assert len(ids.memory.words) < 300


def test_what_is_learned_grows_with_the_pieces_of_words(tokenizer):
    """Words joined by a mark are no words of their own, and what is known isn't learned again."""
    left, right = ([f"{x}{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(200)] for x in ("le", "ri"))
    texts = pa.array([" ".join(f"{a}.{b}" for a in left) for b in right])
    ids, learned = tokens.Ids(tokenizer), []
    learn = ids._learn
    ids._learn = lambda words: learned.extend(words.to_pylist()) or learn(words)
    assert ids.encode(texts).to_pylist() == ids.encode(texts).to_pylist()
    # a word at the start of a text has no space before it, and an empty one ends each text
    assert len(learned) == len(set(learned)) <= len(left) + len(right) + 2


def test_long_words_do_not_fill_the_memory(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10_000)
    texts = [f"{chr(97 + i // 8)}{chr(97 + i % 8)}" * 2500 for i in range(64)]
    ids, t = tokens.Ids(tokenizer), Tokenizer.from_file(PATH)
    assert ids.encode(pa.array(texts), b"", 5_000).to_pylist() == [np.array(t.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in texts]
    assert ids.memory.words.nbytes + ids.memory.ids.nbytes < 5 * 10_000


def test_code_lengths_are_the_shortest():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 300):
        counts = rng.integers(0, 50, n)
        bits = huffman.code_lengths(counts, 18)
        assert (bits > 0).tolist() == (counts > 0).tolist()
        if (counts > 0).sum() > 1:
            import heapq

            heap = [int(c) for c in counts if c]
            heapq.heapify(heap)
            best = 0
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                best += a + b
                heapq.heappush(heap, a + b)
            assert int((bits * counts).sum()) == best
    counts = 2 ** np.arange(30, dtype=np.int64)
    bits = huffman.code_lengths(counts, 6).astype(int)
    assert bits.max() == 6 and (2.0**-bits).sum() <= 1


def test_blocks_decode(tokenizer):
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.2, 5000) % 49408).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1 << 16))
    code = huffman.codes(lengths)
    for n in (0, 1, 1023, 1024, 1025, 2048, 5000):
        load = huffman.segment([3, None], np.array([n, 0]), ids[:n], lengths, code)
        doc_ids, sizes, out = huffman.read_segment(load, huffman.decoding_table(lengths))
        assert doc_ids == [3, None] and sizes.tolist() == [n, 0] and out.tolist() == ids[:n].tolist()


def greedy(word, inner, final, longest):
    """Pieces of word by trying all lengths at each place, or -1."""
    at, n = 0, 0
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + size] in (final if at + size == len(word) else inner):
                break
        else:
            return -1
        at, n = at + size, n + 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = np.random.default_rng(3)
    for _ in range(300):
        inner, final = ({bytes(rng.integers(97, 100, rng.integers(1, 6)).tolist()) for _ in range(rng.integers(0, 20))} for _ in range(2))
        machine = Automaton([*map(tuple, inner), *((*p[:-1], p[-1] + LAST) for p in final)])
        for _ in range(30):
            word = bytes(rng.integers(97, 100, rng.integers(0, 12)).tolist())
            assert machine.count(word) == greedy(word, inner, final, 6)


def test_every_word_of_every_document(spark, sf_dir, tokenizer):
    mark, shown = "</w>", {}
    for b in range(256):
        plain = 33 <= b < 127 or 161 <= b < 173 or 174 <= b
        shown[chr(b) if plain else chr(256 + sum(not (33 <= x < 127 or 161 <= x < 173 or 174 <= x) for x in range(b)))] = b
    pieces = [p for p in json.loads(tokenizer)["model"]["vocab"] if set(p.removesuffix(mark)) <= shown.keys()]
    inner, final = ({bytes(shown[c] for c in p.removesuffix(mark)) for p in pieces if p.endswith(mark) == ends} - {b""} for ends in (False, True))
    longest = max(map(len, inner | final))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    found = {}
    for r in rows:
        words = docs[r.doc_id].encode().lower().split()
        for w in set(words) - found.keys():
            found[w] = greedy(w, inner, final, longest)
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(map(found.__getitem__, words)), 0)
    # all bytes are pieces, inside a word and at its end, so there is no word that can't be cut
    assert all(bytes([b]) in inner and bytes([b]) in final for b in range(256)) and len(found) > 1000


def test_words_of_odd_rows(tokenizer, odd, empty):
    assert automaton(tokenizer).count(b"the") == 1
    assert count_tokens(empty, tokenizer).count() == 0
    rows = count_tokens(odd, tokenizer).collect()
    assert sorted(r.n_words for r in rows) == [0, 0, 0, 3, 3, 5, 11, 3000, 20000]
    assert all(r.n_unknown == 0 and r.n_tokens >= r.n_words for r in rows)


def test_a_word_that_cannot_be_cut_is_one_unknown(spark):
    tokenizer = json.dumps({"model": {"end_of_word_suffix": "</w>", "vocab": {"a": 0, "ab": 1, "b</w>": 2, "</w>": 3, "c</w>": 4}}})
    docs = spark.createDataFrame([(1, "ab aab c ac x a bb B"), (1, "ab aab c ac x a bb B"), (2, "")], "doc_id long, text string")
    # ab: "ab" leaves no end, so it is a, b; aab: a, a, b; ac: a, c; b by itself ends a word; x, a and bb can't be cut
    assert sorted(map(tuple, count_tokens(docs, tokenizer).collect())) == [(1, 8, 12, 3), (1, 8, 12, 3), (2, 0, 0, 0)]
