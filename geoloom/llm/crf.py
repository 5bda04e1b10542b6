"""A linear-chain conditional random field over the words of a text, in numpy.

A word's scores are sums of weights of its features: letter n-grams of 1 to 3 with the word's ends
marked, prefixes and suffixes of 1 to 3 letters, all hashed, and the word itself if it is in the
lexicon (the most frequent words of training).  Features that training never met have no weights and no row.  A transition
weight joins the labels of neighbours.
Training maximises the likelihood by AdaGrad over sequences that switch between spans of texts of
unlike labels, so that the transitions are learned from switches as well; the spans of a text tile it, so every word
counts.  Chains are computed by
forward-backward in segments: all segments of all texts advance in step, first as matrices, which
are joined from segment to segment, then as vectors; the result is that of a plain pass."""

from __future__ import annotations

import numpy as np

from .common import mix64

BITS, LEXICON, SEGMENT = 17, 5000, 48
_NONE = 1 << BITS
#: Numbers that segments' matrices may hold at once; with more, each text is one segment and needs none.
MATRICES = 1 << 23
#: Weights of a model at most: 1024 labels with all hashed features; with more the features of fewest words lose their rows.
MODEL = 1 << 27
#: Words of a span: no fewer, no more.
SHORT, LONG = 6, 40


def _hash(codes: np.ndarray, salt: int) -> np.ndarray:
    return (mix64(codes + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(_NONE - 1)).astype(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    codes, starts, _ = _codes(words)
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes)))
    return np.add.reduceat(mix64(codes + (place.astype(np.uint64) << np.uint64(32))), starts) if len(words) else np.zeros(0, np.uint64)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with marked ends, the words' starts and sizes therein."""
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    starts = np.flatnonzero(codes == 2)
    return codes, starts, np.diff(starts, append=len(codes))


def feature_blocks(words: list[str], lexicon: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks (features, starts): the features of word i in a block begin at starts[i].  Hashed features lie below the
    feature _NONE, which stands for those past a word's end, the lexicon's above it."""
    codes, starts, sizes = _codes(words)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    padded = np.concatenate([codes, np.zeros(3, np.uint64)])
    blocks, h = [], np.zeros(len(codes), np.uint64)
    for n in range(3):
        h = mix64(h * np.uint64(31) + padded[n : n + len(codes)] + np.uint64(1))
        blocks.append((np.where(left > n, _hash(h, n), _NONE), starts))
    one = np.arange(len(words))
    for side in (0, 1):
        h = np.zeros(len(words), np.uint64)
        for n in range(3):
            at = starts + 1 + n if side == 0 else starts + sizes - 2 - n
            h = mix64(h * np.uint64(31) + codes[np.clip(at, 0, len(codes) - 1)] + np.uint64(1))
            blocks.append((np.where(sizes - 2 > n, _hash(h, 3 + 3 * side + n), _NONE), one))
    whole = word_hashes(words)
    at = np.searchsorted(lexicon, whole)
    known = (at < len(lexicon)) & (lexicon[np.minimum(at, len(lexicon) - 1)] == whole) if len(lexicon) else np.zeros(len(words), bool)
    blocks.append((np.where(known, _NONE + 1 + at, _NONE), one))
    return blocks


def emissions(blocks: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    return sum(np.add.reduceat(weights[f], s, axis=0) for f, s in blocks)


def posteriors(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of labels at the words of texts that lie one after another; also the scaled
    forward and backward values, for the gradient of the transitions."""
    n, labels = scores.shape
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    a = np.exp(trans - trans.max(initial=0))
    seg = SEGMENT if int((-(-sizes // SEGMENT)).sum()) * labels * labels <= MATRICES else max(1, int(sizes.max(initial=1)))
    segs = -(-sizes // seg)
    first = np.cumsum(segs) - segs
    starts = np.cumsum(sizes) - sizes
    nth = np.arange(int(segs.sum())) - np.repeat(first, segs)
    at = np.repeat(starts, segs) + nth * seg
    size = np.minimum(seg, np.repeat(sizes, segs) - nth * seg)
    steps = int(size.max(initial=0))
    inside = lambda t: np.flatnonzero(size > t)
    before = np.ones((len(at), labels)) / labels
    after = np.ones((len(at), labels)) / labels
    if (segs > 1).any():
        # segments' matrices: entry (i, j) leads from label i before the segment to j at its end
        m = np.broadcast_to(np.eye(labels), (len(at), labels, labels)).copy()
        for t in range(steps):
            rows = inside(t)
            new = (m[rows].reshape(-1, labels) @ a).reshape(len(rows), labels, labels) * e[at[rows] + t][:, None, :]
            m[rows] = new / new.sum((1, 2), keepdims=True)
        for s in range(1, int(segs.max(initial=1))):
            on = first[segs > s] + s
            # a text's first word has no transition into it
            head = np.einsum("ni,nij->nj", before[on - 1], m[on - 1]) if s > 1 else _first(e, at[on - 1], size[on - 1], a)
            before[on] = head / head.sum(1, keepdims=True)
        for s in range(int(segs.max(initial=1)) - 2, -1, -1):
            on = first[segs > s + 1] + s
            v = np.einsum("nij,nj->ni", m[on + 1], after[on + 1])
            after[on] = v / v.sum(1, keepdims=True)
    alpha, beta = np.zeros((n, labels)), np.zeros((n, labels))
    v = before
    for t in range(steps):
        rows = inside(t)
        g = at[rows] + t
        x = np.where(((nth[rows] == 0) & (t == 0))[:, None], 1.0, v[rows] @ a) * e[g]
        x /= x.sum(1, keepdims=True)
        v[rows] = x
        alpha[g] = x
    v = after
    for t in range(steps - 1, -1, -1):
        rows = inside(t)
        g = at[rows] + t
        beta[g] = v[rows]
        x = (e[g] * v[rows]) @ a.T
        v[rows] = x / x.sum(1, keepdims=True)
    p = alpha * beta
    return p / p.sum(1, keepdims=True), alpha, beta


def _first(e, at, size, a):
    """Forward values at the ends of texts' first segments."""
    v = e[at]
    for t in range(1, int(size.max(initial=0))):
        rows = np.flatnonzero(size > t)
        x = (v[rows] @ a) * e[at[rows] + t]
        v[rows] = x / x.sum(1, keepdims=True)
    return v


def label_sums(score_of, size: int, letters: np.ndarray, trans: np.ndarray, chunk: int) -> np.ndarray:
    """Sums over one text of each label's probability times the words' letters, with one chunk of words held
    at a time: a forward pass keeps the values at the chunks' starts, then the chunks are done from the last to
    the first.  score_of: from a range of words to their scores."""
    a = np.exp(trans - trans.max(initial=0))
    cuts = [*range(0, size, chunk), size]
    scale = lambda x: np.exp(x - x.max(1, keepdims=True)).astype(np.float64)
    heads, v = [], None
    for lo, hi in zip(cuts, cuts[1:]):
        heads.append(v)
        for e in scale(score_of(lo, hi)):
            v = e if v is None else (v @ a) * e
            v = v / v.sum()
    total, back = np.zeros(len(a)), np.ones(len(a)) / len(a)
    for k in range(len(cuts) - 2, -1, -1):
        lo, hi = cuts[k], cuts[k + 1]
        e, v = scale(score_of(lo, hi)), heads[k]
        alpha = np.zeros(e.shape)
        for t in range(hi - lo):
            v = e[t] if v is None else (v @ a) * e[t]
            v = alpha[t] = v / v.sum()
        for t in range(hi - lo - 1, -1, -1):
            p = alpha[t] * back
            total += letters[lo + t] * p / p.sum()
            back = a @ (e[t] * back)
            back /= back.sum()
    return total


def gradient(blocks: list[tuple[np.ndarray, np.ndarray]], inv: np.ndarray, gold: np.ndarray, sizes: np.ndarray, weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood of texts (sizes: their words; inv: each word's place in blocks, gold its label): the rows of weights
    that are met, their gradient, and that of the transitions.  The last row of weights is held at 0."""
    scores = emissions(blocks, weights)[inv]
    prob, alpha, beta = posteriors(scores, sizes, trans)
    g = -prob
    g[np.arange(len(gold)), gold] += 1
    by_word = np.zeros((len(blocks[0][1]), len(trans)))
    np.add.at(by_word, inv, g)
    feats = np.concatenate([f for f, _ in blocks])
    owner = np.concatenate([np.repeat(np.arange(len(s)), np.diff(s, append=len(f))) for f, s in blocks])
    used, back = np.unique(feats, return_inverse=True)
    gw = np.zeros((len(used), len(trans)))
    np.add.at(gw, back, by_word[owner])
    gw[used == len(weights) - 1] = 0
    inner = np.ones(len(inv), bool)
    inner[np.cumsum(sizes) - sizes] = False
    to = np.flatnonzero(inner)
    e = np.exp(scores[to] - scores[to].max(1, keepdims=True, initial=-np.inf))
    ways, ahead = np.exp(trans), e * beta[to]
    z = ((alpha[to - 1] @ ways) * ahead).sum(1, keepdims=True)
    gt = -ways * (alpha[to - 1].T @ (ahead / z))
    np.add.at(gt, (gold[to - 1], gold[to]), 1)
    return used, gw, gt


def spans_of(size: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """A text's words cut into spans of SHORT to LONG words, the last of what is left: together all of them."""
    cuts = [0]
    while cuts[-1] < size:
        cuts.append(min(size, cuts[-1] + int(rng.integers(SHORT, LONG + 1))))
    return list(zip(cuts, cuts[1:]))


class Crf:
    """labels, weights (features, labels), transitions, the lexicon's word hashes, and each feature's row of weights; the last
    row is 0 and that of all features without weights."""

    def __init__(self, labels: list[str], lexicon: np.ndarray, weights: np.ndarray, trans: np.ndarray, row_of: np.ndarray):
        self.labels, self.lexicon, self.weights, self.trans, self.row_of = labels, lexicon, weights, trans, row_of

    def blocks(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.row_of[f], s) for f, s in feature_blocks(words, self.lexicon)]

    def scores(self, words: list[str]) -> np.ndarray:
        return emissions(self.blocks(words), self.weights)

    @classmethod
    def empty(cls, words: list[str], counts: np.ndarray, labels: list[str]) -> "Crf":
        """A model whose rows are the features of these words."""
        hashes = word_hashes(words)
        lexicon = np.unique(hashes[np.argsort(-counts, kind="stable")[:LEXICON]])
        met = np.zeros(_NONE + 1 + len(lexicon), np.int64)
        for at in range(0, len(words), 100_000):
            for f, _ in feature_blocks(words[at : at + 100_000], lexicon):
                met += np.bincount(f, minlength=len(met))
        met[_NONE] = 0
        rows = np.flatnonzero(met)
        if len(rows) * len(labels) > MODEL:
            rows = np.sort(rows[np.argsort(-met[rows], kind="stable")[: MODEL // len(labels)]])
        row_of = np.full(len(met), len(rows))
        row_of[rows] = np.arange(len(rows))
        return cls(labels, lexicon, np.zeros((len(rows) + 1, len(labels)), np.float32), np.zeros((len(labels), len(labels))), row_of)

    @classmethod
    def train(cls, texts: list[list[str]], labels: list[str], epochs: int = 3, rate: float = 0.3, ridge: float = 1e-6, seed: int = 11) -> "Crf":
        """texts: the words of each; labels: the label of each text."""
        names = sorted(set(labels))
        index = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        counts = np.zeros(len(index), np.int64)
        seqs = []
        for t, lab in zip(texts, labels):
            ids = np.fromiter(map(index.__getitem__, t), np.int64, len(t))
            np.add.at(counts, ids, 1)
            seqs.append((ids, names.index(lab)))
        words = list(index)
        model = cls.empty(words, counts, names)
        if not words:
            return model
        weights, trans = model.weights, model.trans
        rng = np.random.default_rng(seed)
        spans = [(ids[a:b], lab) for ids, lab in seqs for a, b in spans_of(len(ids), rng)]
        g2, t2 = np.full(weights.shape[0], 1e-8), np.full(trans.shape, 1e-8)
        batch = max(8, min(800, 4 * (50_000 // len(names))))
        for _ in range(epochs):
            order = rng.permutation(len(spans))
            for b in range(0, len(order), batch):
                part = [spans[i] for i in order[b : b + batch]]
                gold = np.concatenate([np.full(len(p[0]), p[1]) for p in part])
                # four spans in turn make one text that switches
                sizes = np.array([len(p[0]) for p in part])
                sizes = np.add.reduceat(sizes, np.arange(0, len(sizes), 4))
                own, inv = np.unique(np.concatenate([p[0] for p in part]), return_inverse=True)
                used, gw, gt = gradient(model.blocks([words[i] for i in own]), inv, gold, sizes, weights, trans)
                g2[used] += (gw * gw).sum(1)
                weights[used] += (rate * gw / np.sqrt(g2[used])[:, None] - ridge * weights[used]).astype(np.float32)
                t2 += gt * gt
                trans += rate * gt / np.sqrt(t2)
        return model
