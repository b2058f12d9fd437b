"""Hashed subword bags: the feature and model core shared by language ID and toxicity.

A text is a bag of words; a word is a bag of hashed character n-grams (with
boundary marks) plus itself.  Bucket vectors are averaged over the text and feed
a linear softmax; bucket vectors and softmax are trained jointly by minibatch
stochastic gradient descent with per-parameter step sizes, in numpy.  A word
weighs the square root of its count, and ``smooth`` zero vectors join
every average, so that very short texts need more than one odd word.

Because both the average and the softmax input are linear, a trained model folds
into one logit row per bucket and hence one row per *word*; scoring a text is a
sum of cached word rows (see :class:`WordRows`), over the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

#: A word is a run of letters (any script) or of other non-space characters.
WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    """Lower-cased words of a whole text; null and empty texts have none."""
    return WORD.findall(text.lower()) if text else []


def damped(words: Counter) -> np.ndarray:
    """Square roots of the counts: a word's weight in its text."""
    return np.sqrt(np.fromiter(words.values(), np.float64, len(words)))


_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1_000_003)


def ngram_buckets(words: list[str], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams of all words and how many each word has.

    Returns (ids grouped by word, counts per word).  Every word yields at least
    one id: its whole form.
    """
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    arr = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    owner = np.repeat(np.arange(len(words)), lens)
    shift = np.uint64(64 - bits)
    parts, owners = [], []
    with np.errstate(over="ignore"):
        pos = np.arange(len(arr)) - starts[owner]
        weights = (np.arange(int(lens.max()), dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * _MULT
        whole = np.add.reduceat(arr * weights[pos], starts)
        whole ^= whole >> np.uint64(29)
        parts.append(((whole * _MULT) >> shift).astype(np.int32))
        owners.append(np.arange(len(words)))
        for n in sizes:
            if len(arr) < n:
                continue
            h = np.zeros(len(arr) - n + 1, np.uint64)
            for k in range(n):
                h = h * _BASE + arr[k : len(arr) - n + 1 + k]
            ok = owner[: len(h)] == owner[n - 1 :]
            h = h[ok] + np.uint64(n)
            h ^= h >> np.uint64(29)
            parts.append(((h * _MULT) >> shift).astype(np.int32))
            owners.append(owner[: len(ok)][ok])
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return np.concatenate(parts)[order], np.bincount(own, minlength=len(words))


class WordRows:
    """word -> row of a float table, filled lazily by ``make`` and bounded by ``cap``.

    When full the table is emptied; a row is a pure function of its word, so
    results never depend on what is cached.
    """

    def __init__(self, make, cap: int = 200_000):
        self.make, self.cap, self.ids, self.table = make, cap, {}, None

    def load(self, words) -> None:
        missing = [w for w in words if w not in self.ids]
        if not missing:
            return
        if len(self.ids) + len(missing) > self.cap:
            self.ids, missing, self.table = {}, list(words), None
        rows = self.make(missing)
        at = len(self.ids)
        if self.table is None or at + len(rows) > len(self.table):
            grown = np.empty((max(2 * (at + len(rows)), 4096), rows.shape[1]), np.float32)
            if at:
                grown[:at] = self.table[:at]
            self.table = grown
        self.table[at : at + len(rows)] = rows
        self.ids.update(zip(missing, range(at, at + len(rows)), strict=True))

    def pooled(self, words: Counter) -> np.ndarray:
        """Damped sum of the rows of counted words, in double precision."""
        rows = self.table[np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))]
        return damped(words) @ rows.astype(np.float64)


class Bags:
    """Pairs (buckets, counts) of many texts in a few large arrays, which the system gets back when they go.

    Counts are kept in half precision as parts of their text's largest, so a count of any size has a place.
    """

    SIZE = 256

    def __init__(self, pairs):
        self.chunks, held = [], []
        for pair in pairs:
            held.append(pair)
            if len(held) == self.SIZE:
                self._add(held)
                held = []
        if held:
            self._add(held)

    def _add(self, held) -> None:
        ends = np.cumsum([0, *(len(h[0]) for h in held)])
        top = np.array([h[1].max(initial=1.0) for h in held], np.float32)
        self.chunks.append((ends, top, np.concatenate([h[0] for h in held]), np.concatenate([(h[1] / t).astype(np.float16) for h, t in zip(held, top, strict=True)])))

    def __len__(self) -> int:
        return sum(len(c[0]) - 1 for c in self.chunks)

    def __getitem__(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        ends, top, buckets, counts = self.chunks[d // self.SIZE]
        lo, hi = ends[d % self.SIZE], ends[d % self.SIZE + 1]
        return buckets[lo:hi], counts[lo:hi].astype(np.float32) * top[d % self.SIZE]


@dataclass
class SubwordModel:
    """Averaged subword-bag embeddings into a linear softmax with temperature.

    ``min_docs`` leaves out buckets seen in fewer training texts; ``shrink`` is
    a group-lasso step after each update: a bucket's whole vector moves that far
    towards zero, so buckets that carry nothing stay at zero instead of
    memorising single texts.  Vectors start at zero, hence a bucket never seen
    adds nothing.  At least ``steps`` minibatches are taken, however few the
    texts.
    """

    classes: list
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 18
    dim: int = 8
    epochs: int = 10
    steps: int = 1200
    rate: float = 3.0
    seed: int = 7
    smooth: float = 20.0
    min_docs: int = 3
    shrink: float = 0.03
    temperature: float = 1.0
    bias: np.ndarray | None = None
    folded: np.ndarray | None = field(default=None, repr=False)
    #: Buckets with a vector, their vectors and the softmax, as trained (``folded`` is what scoring needs of them).
    parts: tuple | None = field(default=None, repr=False)

    def bags(self, texts) -> Bags:
        """The distinct buckets of each text with their summed damped counts."""
        vocab: dict[str, int] = {}
        words = []
        for text in texts:
            counts = Counter(tokens(text))
            words.append((np.fromiter((vocab.setdefault(w, len(vocab)) for w in counts), np.int32, len(counts)), damped(counts).astype(np.float32)))
        known = list(vocab)
        chunks = [ngram_buckets(known[lo : lo + 20_000], self.sizes, self.bits) for lo in range(0, len(known), 20_000)]
        grams = np.concatenate([np.zeros(0, np.int32), *(c[0] for c in chunks)])
        per_word = np.concatenate([np.zeros(0, np.int64), *(c[1] for c in chunks)])
        del vocab, known, chunks
        ends = np.cumsum(per_word)

        def bag(ids: np.ndarray, damp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = per_word[ids]
            first = np.repeat(ends[ids] - n - (np.cumsum(n) - n), n)
            buckets, at = np.unique(grams[first + np.arange(len(first))], return_inverse=True)
            return buckets, np.bincount(at, np.repeat(damp, n), len(buckets)).astype(np.float32)

        words.reverse()
        return Bags(bag(*words.pop()) for _ in range(len(words)))  # each goes as it is used

    def fit(self, texts, y: np.ndarray, weights: np.ndarray | None = None) -> SubwordModel:
        """Train on an iterable of texts; ``weights`` scales each text's loss."""
        bags = self.bags(texts)
        return self.learn(bags, np.arange(len(bags)), y, np.ones(len(bags)) if weights is None else weights)

    def learn(self, bags: Bags, chosen: np.ndarray, y: np.ndarray, weights: np.ndarray) -> SubwordModel:
        """Train on the ``chosen`` of the bags; ``y`` and ``weights`` are those of all."""
        seen = np.zeros(1 << self.bits, np.int64)
        for d in chosen:
            seen[bags[d][0]] += 1
        known = np.flatnonzero(seen >= self.min_docs)
        place = np.full(1 << self.bits, -1, np.int32)
        place[known] = np.arange(len(known))

        def shares(buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, share = place[buckets], counts / (counts.sum() + self.smooth)  # of all n-grams, those left out included
            return at[at >= 0], share[at >= 0]

        rng = np.random.default_rng(self.seed)
        n_cls = len(self.classes)
        emb = np.zeros((len(known), self.dim), np.float32)
        soft = rng.normal(0, 0.5, (self.dim, n_cls)).astype(np.float32)
        bias = np.zeros(n_cls, np.float32)
        g_emb = np.full(len(known), 1e-8, np.float32)
        g_soft, g_bias = np.full(soft.shape, 1e-6, np.float32), np.full(n_cls, 1e-6, np.float32)
        order, slot, there = np.array(chosen), np.zeros(len(known), np.int32), np.zeros(len(known), bool)
        batches = -(-len(order) // 32)
        for _ in range(max(self.epochs, -(-self.steps // max(batches, 1)))):
            rng.shuffle(order)
            for lo in range(0, len(order), 32):
                pick = order[lo : lo + 32]
                held = [shares(*bags[d]) for d in pick]
                ids = np.concatenate([h[0] for h in held])
                if not len(ids):
                    continue
                there[ids] = True
                uniq = np.flatnonzero(there)
                there[uniq] = False
                slot[uniq] = np.arange(len(uniq))
                mat = np.zeros((len(pick), len(uniq)), np.float32)
                mat[np.repeat(np.arange(len(pick)), [len(h[0]) for h in held]), slot[ids]] = np.concatenate([h[1] for h in held])
                sub = emb[uniq]
                hid = mat @ sub
                z = hid @ soft + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                err = (p * weights[pick, None] / len(pick)).astype(np.float32)
                d_emb = mat.T @ (err @ soft.T)
                d_soft, d_bias = hid.T @ err, err.sum(0)
                g_emb[uniq] += (d_emb**2).mean(1)
                sub -= self.rate * d_emb / np.sqrt(g_emb[uniq])[:, None]
                if self.shrink:
                    sub *= np.maximum(0, 1 - self.shrink / np.maximum(np.sqrt((sub**2).sum(1, keepdims=True)), 1e-9))
                emb[uniq] = sub
                g_soft += d_soft**2
                soft -= 0.2 * self.rate * d_soft / np.sqrt(g_soft)
                g_bias += d_bias**2
                bias -= 0.2 * self.rate * d_bias / np.sqrt(g_bias)
        self.bias, self.folded = bias.astype(np.float64), np.zeros((1 << self.bits, n_cls), np.float32)
        self.folded[known] = emb @ soft
        self.parts = known, emb, soft
        return self

    def rows(self, words: list[str]) -> np.ndarray:
        """Per word: summed logits of its n-grams, then their number."""
        grams, per_word = ngram_buckets(words, self.sizes, self.bits)
        starts = np.cumsum(per_word) - per_word
        sums = np.add.reduceat(self.folded[grams], starts, axis=0)
        return np.column_stack((sums, per_word)).astype(np.float32)

    def logits(self, texts, cache: WordRows) -> np.ndarray:
        """Logits of texts; a text without words gets the bias."""
        out = []
        for text in texts:
            words = Counter(tokens(text))
            cache.load(words.keys())
            total = cache.pooled(words) if words else None
            out.append(self.bias if total is None else self.bias + total[:-1] / (total[-1] + self.smooth))
        return np.array(out).reshape(len(out), len(self.classes))

    def proba(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def calibrate(self, z: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> SubwordModel:
        """Temperature with the least (weighted) log loss on rows kept out of the fit."""
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        if len(y):
            loss = []
            for t in grid:
                self.temperature = float(t)
                loss.append(np.average(-np.log(self.proba(z)[np.arange(len(y)), y] + 1e-12), weights=weights))
            self.temperature = float(grid[int(np.argmin(loss))])
        return self
