import hashlib
import math
import re
import struct
from collections import Counter

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hubflow.llm import fill_in_middle as fim
from hubflow.llm import lexical_search as ls
from hubflow.llm import warc

FRAMES = ["odd", "clashing", "empty"]
ITEMS = "item_id long, text string, doc_id int"


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def ranked(docs, items, k=10):
    """Brute force of search over (doc_id, text) and (item_id, text)."""
    fold = lambda t: re.findall(ls.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    counted = [(d, Counter(fold(t))) for d, t in docs if t is not None and fold(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    out = []
    for item, text in set(items):
        if text is None:
            continue
        scores = []
        for doc, c in counted:
            n, score = sum(c.values()), 0
            m = 25 + 75 * n * n_docs // n_terms
            for term in fold(text):
                if c[term]:
                    df = sum(1 for _, x in counted if x[term])
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -s) for i, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=key)


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("index_bytes", [ls.INDEX_BYTES, 200])
def test_search_by_brute_force(spark, request, frame, index_bytes):
    docs = request.getfixturevalue(frame)
    items = [(1, "one TWO one", 1), (2, None, 1), (3, "", 1), (None, "word three w5x5", 1), (4, "ünïcödé É ΣΊΣΥΦΟΣ don't 漢字かな", 1), (1, "one TWO one", 1), (1, "three", 1), (5, "w1x1 w2x2 no such thing here", 1)]
    got = ls.search(docs, spark.createDataFrame(items, ITEMS), 3, index_bytes).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=key) == ranked([(r.doc_id, r.text) for r in docs.collect()], [x[:2] for x in items], 3)


def test_search_with_ties_and_many_copies(spark):
    docs = [(i, "same text of all" if i % 3 else f"same text {'of ' * (i % 7)}number{i}") for i in range(600, 0, -1)]
    items = [(i, f"same of number{3 * i} all") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = ls.search(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=key) == ranked(docs, items)
    assert ls.search(df, spark.createDataFrame([], ITEMS)).count() == 0


def test_heaps_cut_their_work_anywhere(spark, monkeypatch):
    docs = [(i, " ".join(f"t{(i * j) % 23}" for j in range(i % 11))) for i in range(300)]
    items = [(i, f"t{i % 23} t{i * 5 % 23} t1 t1") for i in range(30)]
    index = ls.indexed([type("R", (), {"item_id": i, "terms": list(c), "times": list(c.values())}) for i, t in items for c in [ls.term_counts(t.encode())[1]]])
    for held in (1, 100, 1 << 20):
        monkeypatch.setattr(ls, "HELD", held)
        monkeypatch.setattr(ls, "PIECE", 3)
        found = [(d, *ls.term_counts(t.encode(), index.terms)) for d, t in docs]
        found = [x for x in found if x[1]]
        n_docs, n_terms = len(found), sum(x[1] for x in found)
        df = Counter(t for _, _, c in found for t in c)
        import numpy as np

        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in range(len(index.terms))], np.int64)
        heaps = ls.Heaps(index, weights, n_docs, n_terms, 4)
        for part in (found[:7], found[7:200], found[200:]):
            sizes = [len(c) for _, _, c in part]
            heaps.add(np.array([d for d, _, _ in part]), np.zeros(len(part), bool), np.array([n for _, n, _ in part]), np.concatenate(([0], np.cumsum(sizes))), np.array([t for _, _, c in part for t in c], np.int64), np.array([x for _, _, c in part for x in c.values()], np.int64))
        got = Counter(zip(heaps.best[0].tolist(), heaps.best[3].tolist(), heaps.best[1].tolist(), strict=True))
        assert got == Counter((i, d, s) for i, _, d, s in ranked(docs, items, 4))


def test_sums_stay_exact_beyond_floating_point():
    import numpy as np

    values = np.array([(1 << 60) + 1, 1, (1 << 59) + 3], np.int64)
    assert ls.exact_sums(np.array([0, 0, 1]), values, 3).tolist() == [(1 << 60) + 2, (1 << 59) + 3, 0]


PAGES = "page_id long, url string, html string"
LONG = "<p>ünï</p>" * 200
ODD_PAGES = [
    (1, "http://a/1", LONG),
    (9, "http://a/9", LONG),
    (9, "http://a/9", LONG),
    (4, None, LONG),
    (None, "http://a/null", LONG),
    (5, "http://a/5", "x" * 999),
    (6, "http://a/6", "x" * 999),
    (7, "http://a/7", "x" * 1000),
    (8, "http://a/8", "x" * 1000),
    (10, "bad\r\nWARC-Type: x\r\n\r\n url", "y" * 100_000),
    (11, "http://a/11", None),
    (12, "http://a/12", ""),
    (None, None, "z" * 2000),
    (None, None, "z" * 2000),
    (13, "http://a/13", "a\r\n\r\nWARC/1.1\r\n\r\n"),
]


def archived(rows, least=1000):
    out, best = [], {}
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        if len(data) >= least:
            best[data] = max(best.get(data, (False, 0, 0)), (page is not None, page or 0, i))
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        is_kept = len(data) < least or best[data][2] == i
        refers = None if is_kept or not best[data][0] else best[data][1]
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if is_kept else "revisit", refers))
    return sorted(out, key=key)


@pytest.mark.parametrize("archive", [warc.ARCHIVE, 3000])
@pytest.mark.parametrize("rows", [ODD_PAGES, []], ids=["odd", "empty"])
def test_archives_give_back_all_pages(spark, rows, archive):
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("digest", "bytes", "number", "key", "size", "keeper", "payload")})
    got = warc.read_archives(warc.write_archives(pages, archive=archive)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == archived(rows)
    stored = {bytes(r.payload) for r in got if r.record_type == "response"}
    assert stored == {(h or "").encode() for _, _, h in rows}
    by_id = {r.record_id: r for r in got}
    assert len(by_id) == len(got)
    for r in got:
        if r.record_type == "revisit":
            other = by_id[r.refers_to_record]
            assert (other.record_type, other.payload_digest, other.payload_bytes) == ("response", r.payload_digest, r.payload_bytes)
    urls = {(r.page_id, r.url) for r in got}
    assert urls >= {(p, u) for p, u, _ in rows if p != 10}


def test_hot_groups_and_others_keep_one_response(spark):
    rows = [(i, f"u{i}", "hot" * 500 if i % 3 else f"{i % 1500} " * 400) for i in range(4000)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(5))).drop("payload").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == archived(rows)


def test_exported_files_are_read_as_such(spark, sf_dir, tmp_path):
    archives = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    sizes = {r.path: r.bytes for r in warc.export_archives(archives, f"file://{tmp_path}/out").collect()}
    files = spark.read.format("binaryFile").load(f"{tmp_path}/out")
    assert sum(sizes.values()) == files.agg(F.sum("length")).first()[0]
    columns = ["page_id", "payload_digest", "record_type", "offset"]
    assert sorted(map(tuple, warc.read_archives(files).select(*columns).collect())) == sorted(map(tuple, warc.read_archives(archives).select(*columns).collect()))
    content = bytes(archives.first().content)
    assert struct.unpack_from("<I", content)[0] == warc.SKIPPABLE
    assert warc.leading_dictionary(memoryview(content))[0][:4] == struct.pack("<I", warc.DICTIONARY)


def content_of(*made, load=b""):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(load)) if load else zstandard.ZstdCompressor()
    return warc.dictionary_frame(load) + b"".join(packer.compress(x) for x in made)


def response(payload=b"abc", **other):
    return warc.record("response", "<urn:x-page:1:1>", payload, other.get("size", len(payload)), other.get("digest", hashlib.sha1(payload).hexdigest()), "http://a")


def read(content):
    return [(r.fields["warc-type"], warc.answer(r)) for r in warc.records(content)]


def test_reader_takes_what_the_format_allows():
    assert read(b"") == []
    other_skippable = struct.pack("<II", 0x184D2A51, 3) + b"abc"
    assert [x for x, _ in read(content_of(response()) + other_skippable + content_of(response(b"d" * 100_000)))] == ["response", "response"]
    raw = struct.pack("<II", warc.SKIPPABLE, len(LOAD)) + LOAD
    packed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(LOAD)).compress(response())
    assert read(raw + packed)[0][1][2] == b"abc"
    lower = response().replace(b"WARC-Type", b"warc-type").replace(b"WARC/1.1", b"WARC/1.0")
    assert read(content_of(lower))[0][0] == "response"


LOAD = zstandard.train_dictionary(1000, [f"{i} WARC response {i * 7}".encode() * 3 for i in range(300)]).as_bytes()


@pytest.mark.parametrize(
    "content",
    [
        content_of(response())[:-1],
        content_of(response(), load=LOAD)[:20],
        struct.pack("<II", warc.SKIPPABLE, 4) + b"nope" + content_of(response()),
        zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(LOAD)).compress(response()),
        content_of(response() + response()),
        content_of(response()[:-1]),
        content_of(response().replace(b"Content-Length: 3", b"Content-Length: 4")),
        content_of(response(digest="0" * 40)),
        content_of(response(size=5)),
        content_of(response().replace(b"WARC/1.1", b"WARC/9")),
        content_of(response().replace(b"WARC-Date", b"WARC Date")),
        content_of(response().replace(b"WARC-Date: ", b"X-Date: ")),
        content_of(response().replace(b"WARC-Type: response", b"WARC-Type: response\r\nwarc-type: revisit")),
        content_of(response().replace(b"abc", b"abd")),
        content_of(b"no record at all"),
        b"\0" * 50,
        content_of(response().replace(b"WARC-Type: response", b"WARC-Type: revisit")),
    ],
)
def test_reader_refuses_what_does_not_hold(content):
    with pytest.raises(warc.BadArchive):
        read(content)


def test_a_bad_archive_is_named(spark):
    df = spark.createDataFrame([("some.warc.zst", bytearray(content_of(response())[:-3]))], "path string, content binary")
    with pytest.raises(Exception, match="some.warc.zst: the frame at 0 is cut off"):
        warc.read_archives(df).collect()


def middle(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        form, out = "plain", text
    else:
        form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    chars = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, n, form, *chars, out)


def digests(row):
    *about, out = row
    return (*about, hashlib.sha256(out.encode()).hexdigest())


MIDDLE = [
    (20, "a\nb\nc"),
    (21, "\n\n\n"),
    (22, "ends\n"),
    (23, "holds <P> itself\nand more"),
    (24, "<\n<S\n<M\n>\nP>\n" * 4),
    (25, "ünï\r\n漢字 x\x0by\n\U0001f600" * 5),
    (26, "one line of many bytes " * 9000),
    (27, "line é of some bytes\n" * 9000 + "last"),
    (27, "line é of some bytes\n" * 9000 + "last"),
    (28, "<"),
]


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (70, 100)])
@pytest.mark.parametrize("frame", FRAMES)
def test_middles_by_brute_force(spark, request, frame, rate, spm):
    docs = request.getfixturevalue(frame)
    if frame == "odd":
        docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(MIDDLE, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = fim.fill_in_middle(docs, 7, rate, spm).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=key) == sorted((digests(middle(d, t, 7, rate, spm)) for d, t in rows), key=key)
    assert sorted((r.restored_sha256, r.output_sha256) for r in got) == sorted((hashlib.sha256((t or "").encode()).hexdigest(), digests(middle(d, t, 7, rate, spm))[-1]) for d, t in rows)


def test_pieces_join_to_outputs(spark):
    docs = spark.createDataFrame(MIDDLE, "doc_id long, text string")
    rows = fim.assembled(docs).collect()
    assert max(len(r.load) for r in rows) <= fim.CHUNK
    out = {}
    for r in rows:
        out.setdefault((r.row, r.doc_id), []).append((r.place, bytes(r.load)))
    assert all([p for p, _ in x] == list(range(len(x))) for x in out.values())
    assert sorted((d, b"".join(y for _, y in x).decode()) for (_, d), x in out.items()) == sorted((d, middle(d, t)[-1]) for d, t in MIDDLE)


@settings(max_examples=200, deadline=None)
@given(st.text("<PSM>ab\n", max_size=40), st.integers(0, 1000), st.data())
def test_parts_are_found_however_the_output_is_cut(text, doc_id, data):
    *_, form, _, _, out = middle(doc_id, text)
    parts, found, at, load = fim.Parts(form), {fim.PREFIX: b"", fim.MIDDLE: b"", fim.SUFFIX: b""}, 0, out.encode()
    while at < len(load):
        end = at + data.draw(st.integers(1, 5))
        for part, _, x in parts.feed(load[at:end]):
            found[part] += x
        at = end
    parts.end()
    assert b"".join(found[k] for k in (fim.PREFIX, fim.MIDDLE, fim.SUFFIX)).decode() == text


def test_an_output_without_its_marks_is_an_error():
    parts = fim.Parts("psm")
    parts.feed(b"<P>abc<S>d")
    with pytest.raises(ValueError, match="<M>"):
        parts.end()
