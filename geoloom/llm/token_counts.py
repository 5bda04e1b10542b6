"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary's pieces form two tries over bytes, one for a word's first piece and one for the
others.  Where the walk along a word can't go on, a node's failure link leads to the node that
stands for the rest of what was read once the longest pieces are taken off, and a precomputed count
says how many pieces were popped on the way.  Each byte moves the walk on once, so a word costs
time in proportion to its length and no piece is ever built.  A word that the vocabulary can't
cover is one unknown token.

The vocabulary is that of a byte-level tokenizer file: pieces that begin with its mark of a blank
start words, the others continue them.  Words are runs of letters, digits and underscores, and single
other signs; white space is dropped.

Nulls: a null text is an empty one and has no tokens.  Null and repeated doc_ids are rows of their
own.  An empty table gives no rows; other columns are not read."""

from __future__ import annotations

import json
import re
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_encoder import BYTE_LETTERS
from .common import arrow_map, own_memo, texts_of

WORD = re.compile(r"\w+|[^\w\s]")
#: Words kept at most, and the longest that is kept.
MEMO_WORDS, MEMO_CHARS = 1_000_000, 48
_UNKNOWN = -1


class Automaton:
    def __init__(self, firsts, others):
        """firsts, others: the byte strings of pieces that start and continue words."""
        self.child: dict[int, int] = {}
        self.ends: list[bool] = [False, False]
        for root, pieces in ((0, firsts), (1, others)):
            for piece in pieces:
                self._add(root, piece)
        self._link()

    def _add(self, node: int, piece: bytes) -> None:
        for byte in piece:
            key = node << 8 | byte
            if key not in self.child:
                self.child[key] = len(self.ends)
                self.ends.append(False)
            node = self.child[key]
        self.ends[node] = node > 1

    def _link(self) -> None:
        """Failure links and popped pieces, breadth first; -1: no link."""
        n = len(self.ends)
        self.fail, self.pops = [-1] * n, [0] * n
        kids: dict[int, list[tuple[int, int]]] = {}
        for key, v in self.child.items():
            kids.setdefault(key >> 8, []).append((key & 255, v))
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for byte, v in kids.get(u, ()):
                queue.append(v)
                if self.ends[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and (z << 8 | byte) not in self.child:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.child[z << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Greedy pieces of a word that isn't empty, or -1 if it can't be covered."""
        child, fail, pops = self.child, self.fail, self.pops
        node = total = 0
        for byte in word:
            while (to := child.get(node << 8 | byte)) is None:
                total += pops[node]
                if (node := fail[node]) < 0:
                    return _UNKNOWN
            node = to
        while node != 1:
            total += pops[node]
            if (node := fail[node]) < 0:
                return _UNKNOWN
        return total


def pieces_of(path: str) -> tuple[set[bytes], set[bytes]]:
    """First and other pieces of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = {letter: b for b, letter in BYTE_LETTERS.items()}
    mark, firsts, others = BYTE_LETTERS[32], set(), set()
    for piece in vocab:
        if all(x in byte for x in piece):
            own = piece[1:] if piece[0] == mark else piece
            (firsts if piece[0] == mark else others).add(bytes(byte[x] for x in own))
    return firsts - {b""}, others - {b""}


class Counter:
    """Counts of texts with a memo of words."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.memo = automaton, {}

    def text(self, text: str) -> tuple[int, int, int]:
        """Words, tokens (an unknown word is one) and unknown words."""
        words = WORD.findall(text)
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        got = list(map(self.memo.get, words))
        at = -1
        for _ in range(got.count(None)):
            at = got.index(None, at + 1)
            word = words[at]
            if (n := self.memo.get(word)) is None:
                n = self.automaton.count(word.encode())
                if len(word) <= MEMO_CHARS:
                    self.memo[word] = n
            got[at] = n
        unknown = got.count(_UNKNOWN)
        return len(words), sum(got) + 2 * unknown, unknown


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    own_memo("counts", _counters.clear)
    if path not in _counters:
        _counters[path] = Counter(Automaton(*pieces_of(path)))
    return _counters[path]


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of each whole text."""

    def make():
        count = counter(vocab_path).text

        def f(batch):
            rows = [count(t) for t in texts_of(batch)]
            return {"doc_id": batch.column("doc_id")} | {x: [r[i] for r in rows] for i, x in enumerate(("n_words", "n_tokens", "n_unknown"))}

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, make, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op5_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of all documents."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
