"""N-best segmentation into SentencePiece pieces, and decoding.

A text's segmentations are the paths of its piece lattice, scored by the sum of the pieces' scores.
A forward Viterbi pass gives the best score up to each place; a search backward from the end takes
it as an exact heuristic (A*): what lies before a place can't score better, and some path attains it,
so complete paths come off the queue in falling order of score.  Characters without a piece fall
back to their bytes.

Where no piece of the vocabulary leads across - into a word mark, over a line break, most often from
a letter to a sign - the lattice falls apart: paths of a text are independent choices in its parts.  Parts are searched alone, remembered with
their best path and the loss of their second best, and the N best of a text follow from the N - 1 parts
of least loss, as any path that leaves the best one elsewhere scores below N others (equal
scores: the earlier part).

Scores and normalisation are the model file's: a piece's score is the one stored for it (the logarithm of a probability
in a unigram model, less the number of its merge in a merge model), and a text passes the file's normaliser, which also
turns blanks into marks and adds one before the text if the file says so.  A character without a piece counts
UNKNOWN_PENALTY below the least score of any piece, as the library has it, and is written as its bytes; a model without
byte pieces writes its unknown piece.

Decoding undoes the marks; it is exact where the normaliser changes nothing and the text doesn't hold the mark itself.
Nulls: a null text is an empty one and has no pieces and one (empty) path.  Null and repeated doc_ids are rows of their own.
A text without any border between parts is one part: its search keeps one score a character and finds the edges into a place
only when a path leads there.  An empty table gives no rows; other columns are not read."""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, own_memo, texts_of

MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Scores are whole numbers, held as floats, of a part of one: this part, or a larger one where the file's scores are so large that
#: the sum of LONG of them would not be exact.
UNIT, LONG = 1 << 20, 4096
#: Parts kept at most, and the longest that is kept.
MEMO_PARTS, MEMO_CHARS = 1_300_000, 48
_PART = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_LETTER = re.compile("[a-zA-ZÀ-ɏ]")
_WORD_PART = re.compile(f"{MARK}*[a-zA-ZÀ-ɏ]+|\n|{MARK}*[^{MARK}\na-zA-ZÀ-ɏ]+|{MARK}+")
_INNER_MARK = re.compile(f"[^{MARK}]{MARK}|.\n|\n.", re.S)


class Pieces:
    """A vocabulary of pieces with their ids and scores."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: dict[int, int], skip: set[int] = frozenset(), unknown: int = 0, normalize=None):
        """bytes_at: the id of each byte's piece, if there are any; skip: ids that aren't text; unknown: the id of what has no
        piece; normalize: from texts to marked texts."""
        texts = [(p, i) for i, p in enumerate(pieces) if i not in skip and i not in set(bytes_at.values())]
        top = max((abs(scores[i]) for _, i in texts), default=1.0) + UNKNOWN_PENALTY
        self.unit = min(UNIT, 2 ** max(0, 52 - math.frexp(top * LONG)[1]))
        self.score = {p: float(round(self.unit * scores[i])) for p, i in texts}
        self.id = {p: i for p, i in texts}
        self.unknown_score = min(self.score.values(), default=0) - self.unit * UNKNOWN_PENALTY
        self.bytes_at, self.unknown = bytes_at, unknown
        self.normalize = normalize or (lambda texts: [MARK + t.replace(" ", MARK) if t else "" for t in texts])
        probe = self.normalize(["a"])[0]
        self.lead, self.tail = probe.startswith(MARK), probe.endswith(MARK)
        self.decoded = {unknown: " \u2047 ".encode()} | {i: p.encode() for p, i in texts} | {i: bytes([b]) for b, i in bytes_at.items()}
        #: Nodes (children, score) of pieces forward, and (children, score, ids) of pieces read backward; a node
        #: that ends no piece has no score.
        self.trie: dict[str, list] = {}
        self.back: dict[str, list] = {}
        for p, i in texts:
            children = self.trie
            for c in p:
                node = children.setdefault(c, [{}, None])
                children = node[0]
            node[1] = self.score[p]
            children = self.back
            for c in reversed(p):
                node = children.setdefault(c, [{}, None, None])
                children = node[0]
            node[1:] = self.score[p], (i,)
        #: Neighbours that some piece holds; between all others every path has a border.
        self.inner = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.split = not any(_INNER_MARK.search(p) for p in self.score)
        self.part_pattern = self._pattern()
        self.memo = Memo(self)

    def _pattern(self) -> re.Pattern:
        """Cuts between Latin letters and other signs as well, if no piece joins them."""
        mixed = any(a != MARK and bool(_LETTER.match(a)) != bool(_LETTER.match(b)) for a, b in self.inner)
        return _PART if mixed else _WORD_PART

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        at = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], at, skip, max(0, sp.unk_id()), sp.normalize)

    def forward(self, text: str) -> tuple[list[float], list[int], list[float]]:
        """Of each place the best score up to it, the start of the piece that ends there on the best path (of equal
        ones the longest piece), and the loss if the second best piece ends there."""
        size, trie, unknown = len(text), self.trie, self.unknown_score
        best, start, loss = [0.0] + [-math.inf] * size, [0] * (size + 1), [math.inf] * (size + 1)
        for a, first in enumerate(text):
            base, node, b = best[a], trie.get(first), a
            if node is None or node[1] is None:
                node = [node[0] if node else {}, unknown]
            while node:
                b += 1
                children, s = node
                if s is not None:
                    gain = base + s - best[b]
                    if gain > 0:
                        best[b], start[b], loss[b] = base + s, a, gain
                    elif -gain < loss[b]:
                        loss[b] = -gain
                if b == size or not children:
                    break
                node = children.get(text[b])
        return best, start, loss

    def _unknown_ids(self, char: str) -> list[int]:
        return [self.bytes_at[x] for x in char.encode()] if self.bytes_at else [self.unknown]

    def edges(self, text: str, at: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """The pieces that end at a place: (start, score, ids)."""
        last = text[at - 1]
        node, a, out = self.back.get(last), at, []
        if node is None or node[1] is None:
            out.append((at - 1, self.unknown_score, tuple(self._unknown_ids(last))))
        while node:
            a -= 1
            children, s, ids = node
            if s is not None:
                out.append((a, s, ids))
            node = children.get(text[a - 1]) if a else None
        return out

    def search(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths (score, ids) of one lattice, best first.

        Of equal scores the path nearer the text's start goes first, and no place is left more than n
        times, so the queue stays in proportion to the text even if every path scores the same."""
        best, edges_at = self.forward(text)[0], self.edges
        push, pop = heapq.heappush, heapq.heappop
        if not text:
            return [(0.0, ())]
        heap = [(-best[-1], len(text), 0, 0.0, None)]
        out, left, made = [], Counter(), 0
        while heap and len(out) < n:
            loss, at, _, after, path = pop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((-loss, tuple(ids)))
                continue
            left[at] += 1
            if left[at] > n:
                continue
            edges = edges_at(text, at)
            while len(edges) == 1:  # no choice: on to the edge's start without the queue
                at, s, own = edges[0]
                after += s
                path = own, path
                edges = edges_at(text, at) if at else ()
            if at == 0:
                made += 1
                push(heap, (loss, 0, made, after, path))
                continue
            for a, s, own in edges:
                made += 1
                push(heap, (-(best[a] + s + after), a, made, s + after, (own, path)))
        return out

    def part(self, text: str) -> tuple[float, bytes, int, float]:
        """Best score, its ids (little-endian unsigned 32-bit), their number, loss of the second best.
        A part falls apart further between neighbours that no piece holds."""
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.inner]
        if cuts:
            own = [self.memo[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)])]
            return sum(g[0] for g in own), b"".join([g[1] for g in own]), sum(g[2] for g in own), min(g[3] for g in own)
        best, start, loss = self.forward(text)
        at, least, ids = len(text), math.inf, []
        while at:  # the second best path leaves the best one, seen from the end, where that loses least
            if loss[at] < least:
                least = loss[at]
            a = start[at]
            i = self.id.get(text[a:at])
            if i is None:
                ids += reversed(self._unknown_ids(text[a]))
            else:
                ids.append(i)
            at = a
        ids.reverse()
        return best[-1], struct.pack(f"<{len(ids)}I", *ids), len(ids), least

    def parts(self, marked: str) -> list[str]:
        if not marked:
            return []
        return self.part_pattern.findall(marked) if self.split else [marked]

    def changes(self, marked: str, n: int) -> tuple[bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        """Of a normalised text the best path's ids (little-endian unsigned 32-bit) and the n best paths in falling order as
        (score, changes): what they put in place of runs of the best path's pieces (place, number, ids)."""
        if len(self.memo) > MEMO_PARTS:
            self.memo.clear()
        parts = self.parts(marked)
        if not parts:
            return b"", [(0.0, [])]
        got = list(map(self.memo.__getitem__, parts))
        ids, total, losses = [g[1] for g in got], sum([g[0] for g in got]), np.array([g[3] for g in got])
        near = [int(i) for i in _least(losses, min(n - 1, len(losses))) if losses[i] < math.inf]
        # the n best combinations: one choice in each part, best first
        ways: list[tuple[float, list[tuple[int, tuple[int, ...]]]]] = [(0.0, [])]
        for i in near:
            paths = self.search(parts[i], n)
            more = [(loss + paths[0][0] - s, [*way, (i, p)] if k else way) for loss, way in ways for k, (s, p) in enumerate(paths)]
            ways = sorted(more, key=lambda w: w[0])[:n]
        place = np.cumsum([0] + [g[2] for g in got]) if near else ()
        named = lambda i, p: (int(place[i]), got[i][2], np.array(p, "<u4").tobytes())
        return b"".join(ids), [((total - loss) / self.unit, sorted(named(i, p) for i, p in way)) for loss, way in ways]

    def nbest(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text: (score, ids as little-endian unsigned 32-bit)."""
        best, paths = self.changes(self.normalize([text])[0], n)
        return [(score, changed(best, way)) for score, way in paths]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode(errors="replace").replace(MARK, " ")
        if self.lead and text[:1] == " ":
            return text[1:]
        return text[:-1] if self.tail and text[-1:] == " " else text


def changed(best: bytes, way: list[tuple[int, int, bytes]]) -> bytes:
    """A path's ids from the best path's and its changes, which are in order of place."""
    out, at = [], 0
    for place, number, ids in way:
        out += [best[4 * at : 4 * place], ids]
        at = place + number
    return b"".join([*out, best[4 * at :]])


def described(best: bytes, score: float, way: list[tuple[int, int, bytes]]) -> dict:
    ids = changed(best, way) if way else best
    return {"score": score, "n_pieces": len(ids) // 4, "ids_crc32": zlib.crc32(ids), "changes": [{"place": a, "number": k, "ids": i} for a, k, i in way]}


class Memo(dict):
    """Parts with their best path and second loss; long ones aren't kept."""

    def __init__(self, owner: Pieces):
        self.owner = owner

    def __missing__(self, part: str) -> tuple[float, bytes, int, float]:
        got = self.owner.part(part)
        if len(part) <= MEMO_CHARS:
            self[part] = got
        return got


def _least(losses: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least losses, the earlier ones of equals."""
    if not n:
        return np.zeros(0, np.int64)
    limit = np.partition(losses, n - 1)[n - 1]
    some = np.flatnonzero(losses <= limit)
    return some[np.argsort(losses[some], kind="stable")][:n]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    own_memo("pieces", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Pieces.load(path)
    return _loaded[path]


def segment(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of the best path, the n best paths (score, number of pieces, crc32 of their ids as little-endian unsigned
    32-bit integers, and changes against the best: place, number of pieces replaced, ids) and whether the best one
    decodes to the text."""

    def make():
        model = pieces(model_path)

        def f(batch):
            texts = texts_of(batch)
            found = [model.changes(t, n) for t in model.normalize(texts)]
            return {
                "doc_id": batch.column("doc_id"),
                "ids": [best for best, _ in found],
                "paths": [[described(best, s, way) for s, way in paths] for best, paths in found],
                "exact": [model.decode(best) == t for (best, _), t in zip(found, texts)],
            }

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, make, "doc_id long, ids binary, paths array<struct<score: double, n_pieces: long, ids_crc32: long, changes: array<struct<place: long, number: long, ids: binary>>>>, exact boolean")


def digest(found: DataFrame) -> DataFrame:
    """Of each document: n_paths, of all paths scores, n_pieces and ids_crc32, best first, and exact."""
    of = lambda x: F.transform("paths", lambda p: p[x])
    return found.select("doc_id", F.size("paths").alias("n_paths"), of("score").alias("scores"), of("n_pieces").alias("n_pieces"), of("ids_crc32").alias("ids_crc32"), "exact")


def op7_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 best segmentations of all documents: scores, numbers of pieces and crc32 of each."""
    import public_tokenizers

    return digest(segment(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")))
