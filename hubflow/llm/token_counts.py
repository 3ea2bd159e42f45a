"""Token counts without tokens: greedy longest-match word pieces by a linear automaton.

The vocabulary's trie has a failure link in each node, and the number of pieces that are popped when it is followed:
the longest first pieces of the node's string, as many as leave a string of the trie. So a word is read once, left
to right, and no piece is built.
"""

import json
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.tokens import read_tokenizer, sc_broadcast

#: Added to a word's last byte. No inner piece holds such a symbol, so none can take a word's end from the piece that fits it.
LAST = 256
SYMBOLS = 512
NONE = -1
REMEMBERED = 500_000


class Automaton:
    """Pieces are tuples of symbols: bytes, with LAST added to the last one of a piece that ends words."""

    def __init__(self, pieces):
        self.go: dict[int, int] = {}
        self.fail, self.popped = array("i", [NONE]), array("i", [0])
        final, levels = {0: False}, [[(0, 0, 0)]]
        for piece in pieces:
            node = 0
            for depth, symbol in enumerate(piece, 1):
                key = node * SYMBOLS + symbol
                if key not in self.go:
                    self.go[key] = len(final)
                    final[len(final)] = False
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((self.go[key], node, symbol))
                node = self.go[key]
            final[node] = bool(piece)
        self.fail.extend([NONE] * (len(final) - 1))
        self.popped.extend([0] * (len(final) - 1))
        for level in levels[1:]:
            for node, parent, symbol in level:
                if final[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, popped = self.fail[parent], self.popped[parent]
                while at != NONE and at * SYMBOLS + symbol not in self.go:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at != NONE:
                    self.fail[node], self.popped[node] = self.go[at * SYMBOLS + symbol], popped

    def count(self, word: bytes) -> int:
        """Pieces of word, or -1 where greedy matching comes to bytes that no piece begins with."""
        go, fail, popped, node, out = self.go, self.fail, self.popped, 0, 0
        if not word:
            return 0
        for symbol in (*word[:-1], word[-1] + LAST):
            while (to := go.get(node * SYMBOLS + symbol)) is None:
                out += popped[node]
                node = fail[node]
                if node == NONE:
                    return -1
            node = to
        while node:
            out += popped[node]
            node = fail[node]
            if node == NONE:
                return -1
        return out


def word_pieces(tokenizer: str) -> list[tuple[int, ...]]:
    """The vocabulary of a byte-level tokenizers file with a mark for word ends, as symbols; a mark alone ends no word."""
    model = json.loads(tokenizer)["model"]
    mark = model["end_of_word_suffix"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = []
    for piece in model["vocab"]:
        body = piece.removesuffix(mark)
        if all(c in shown for c in body):
            symbols = [shown[c] for c in body]
            if body != piece and body:
                symbols[-1] += LAST
            if body:
                out.append(tuple(symbols))
    return out


@lru_cache(1)
def automaton(tokenizer: str) -> Automaton:
    return Automaton(word_pieces(tokenizer))


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for each row of docs (doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; each is cut from the left into the longest piece of the
    vocabulary that fits. A word that can't be cut counts as one token and one unknown. Null and empty texts have zeros;
    repeated rows count each for itself; other columns are ignored.
    """
    shared = sc_broadcast(docs, tokenizer)

    def count(batches):
        machine, known = automaton(shared.value), {}
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                words = (text or "").encode().lower().split()
                for w in set(words):
                    if w not in known:
                        known[w] = machine.count(w)
                found = list(map(known.__getitem__, words))
                unknown = found.count(-1)
                out.append((len(words), sum(found) + 2 * unknown, unknown))
                if len(known) > REMEMBERED:
                    known = {}
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.record_batch([batch["doc_id"], *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))


def op3_sql() -> str:
    """The same by trying all lengths at each place of each distinct word, in hexadecimal bytes; the vocabulary is read from its file."""
    import public_tokenizers

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH RECURSIVE vocabulary AS (SELECT unnest(json_keys(content, '$.model.vocab')) AS piece, content ->> '$.model.end_of_word_suffix' AS mark FROM read_text('{public_tokenizers.path("word_bpe_49k.json")}')),
    b AS (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 AS plain FROM range(256) t(b)),
    shown AS (SELECT chr(CAST(CASE WHEN plain THEN b ELSE 255 + count(*) FILTER (NOT plain) OVER (ORDER BY b) END AS INTEGER)) AS c, printf('%02X', b) AS hex FROM b),
    body AS (SELECT piece, suffix(piece, mark) AS ends, CASE WHEN suffix(piece, mark) THEN left(piece, len(piece) - len(mark)) ELSE piece END AS body FROM vocabulary),
    letters AS (SELECT piece, ends, len(body) AS n, unnest(string_split(body, '')) AS c, generate_subscripts(string_split(body, ''), 1) AS i FROM body WHERE body <> ''),
    pieces AS MATERIALIZED (SELECT string_agg(hex, '' ORDER BY i) AS hex, ends FROM letters JOIN shown USING (c) GROUP BY piece, ends, n HAVING count(*) = n),
    longest AS (SELECT max(len(hex)) // 2 AS longest FROM pieces),
    d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, list_transform(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+'), lambda x: hex(x)) AS words FROM documents),
    w AS MATERIALIZED (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM d) GROUP BY ALL),
    cut AS (SELECT DISTINCT word, 0 AS place, 0 AS n FROM w
      UNION ALL SELECT word, place + max(size), n + 1 FROM (SELECT word, place, n, unnest(range(1, CAST(least(len(word) // 2 - place, (SELECT longest FROM longest)) AS BIGINT) + 1)) AS size FROM cut WHERE 2 * place < len(word))
      JOIN pieces p ON p.hex = substr(word, 2 * place + 1, 2 * size) AND p.ends = (2 * (place + size) = len(word)) GROUP BY word, place, n),
    known AS (SELECT word, max(place) * 2 = len(word) AS known, max(n) AS pieces FROM cut GROUP BY word),
    t AS (SELECT row, sum(w.n * CASE WHEN known THEN pieces ELSE 1 END) AS n_tokens, sum(CASE WHEN known THEN 0 ELSE w.n END) AS n_unknown FROM w JOIN known USING (word) GROUP BY row)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, CAST(coalesce(n_unknown, 0) AS BIGINT) AS n_unknown FROM d LEFT JOIN t USING (row)"""
