"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy, over all windows of a text.

A word enters the network by a learnt vector of its hash, by the mean of learnt vectors of its character 4- and
5-grams, and by what is known about either: how much more often than expected the word, its most telling n-grams
and its n-grams on average occur in toxic training documents. Evidence is cross-fitted: a training document's own
fold isn't counted. Vectors begin at 0 and are dropped at random while training, so that words never seen add
nothing and the network doesn't lean on words that it knows by heart.

Windows of ``WINDOW`` words begin at every ``STRIDE``-th word and cover the whole text, so that any passage of
WINDOW - STRIDE + 1 words lies in one of them. A document's score is calibrated from its largest logits. Training
learns from documents' labels: of a toxic document those windows count as toxic that score highest, in turns.

Labels are learnt from at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows (those whose ids' hashes are
least) of at most ``TRAIN_CHARS`` code points, and never from held-out rows, crc32(doc_id as text) mod 3 being 1.
So the sample has a fixed size; one task of an executor trains, the driver only passes the weights on. Only the
text is an input.

Input cases: null and empty text, or text without words, get the share of toxic rows among the training
labels; very long texts are scored whole, in blocks; repeated rows get equal scores; of rows with one doc_id but
different texts the least text is learnt from; without labels of both kinds every score is 0; extra columns are
kept by ``drop_toxic`` whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.bytehash import chunks, hashes, words
from quernel.llm.common import ship, table

WINDOW, STRIDE = 32, 8
HIDDEN = 6
#: Learnt vectors: their length, and hash buckets of words and of character n-grams.
VECTOR, WORD_VECTORS, GRAM_VECTORS = 4, 1 << 14, 1 << 15
DROP = 0.5
THRESHOLD = 0.7
TOXIC_ROWS, CLEAN_ROWS = 1200, 2400
#: Code points of a training text at most; longer ones are scored but not learnt from.
TRAIN_CHARS = 20_000
FOLDS = 4
STEPS, BATCH = 700, 64
#: Windows that are learnt from begin at every so many words.
TRAIN_STRIDE = 24
WORD_BITS, GRAM_BITS = 17, 18
EVIDENCE = 5
INPUT = EVIDENCE + 2 * VECTOR
_BLOCK = 2048

#: Bytes that part words: ASCII that is neither digit nor letter.
_PARTS = np.array([c < 128 and not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123) for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_PARTS] = 32


def _grams(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-byte grams of folded text with a space at both ends, and which of them lie in one word.

    A gram may begin or end with the space beside its word.
    """
    d = np.concatenate([[32], _LOWER[data], [32]]).astype(np.uint64)
    m = len(d) - n + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    v = d[:m].copy()
    for k in range(1, n):
        v = (v << np.uint64(8)) | d[k : k + m]
    v *= np.uint64(0x9E3779B97F4A7C15)
    gap = d == 32
    inner = gap[1 : 1 + m].copy()
    for k in range(2, n - 1):
        inner |= gap[k : k + m]
    return ((v >> np.uint64(64 - GRAM_BITS + 1)) | np.uint64((n & 1) << (GRAM_BITS - 1))).astype(np.int64), ~inner


@dataclass
class Words:
    """The words of some texts: which distinct word stands at each place, and what distinct words are made of."""

    place: np.ndarray  # the distinct word at each place
    at: np.ndarray  # the first place of each text, one more at the end
    word: np.ndarray  # of each distinct word its hash
    size: np.ndarray  # and its bytes
    grams: np.ndarray  # the buckets of its n-grams, word after word
    gram_at: np.ndarray  # where each one's n-grams begin, one more at the end

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        starts, ends, at = words(data, offsets, True, _PARTS)
        h, first, place = np.unique(hashes(data, starts, ends, True), return_index=True, return_inverse=True)
        size = (ends - starts)[first]
        # Each distinct word once, followed by a space.
        begin = np.cumsum(size + 1) - (size + 1)
        index = np.arange(int((size + 1).sum())) + np.repeat(starts[first] - begin, size + 1)
        flat = data[np.minimum(index, max(0, len(data) - 1))].copy() if len(index) else np.zeros(0, np.uint8)
        flat[begin + size] = 32
        found, owner = [], []
        for n in (4, 5):
            b, ok = _grams(flat, n)
            k = np.flatnonzero(ok)
            found.append(b[k])
            # Places count from the space before a word.
            owner.append(np.searchsorted(begin, k, "right") - 1)
        owner_all = np.concatenate(owner)
        order = np.argsort(owner_all, kind="stable")
        return cls(place, at, h, size, np.concatenate(found)[order], np.searchsorted(owner_all[order], np.arange(len(h) + 1)))


def evidence_inputs(w: Words, word_table: np.ndarray, gram_table: np.ndarray) -> np.ndarray:
    """For each distinct word: its evidence, the largest of its n-grams and of its 5-grams alone, its n-grams' mean, and its length."""
    x = np.zeros((len(w.word), EVIDENCE), np.float32)
    x[:, 0] = word_table[(w.word >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
    g = gram_table[w.grams]
    for k, (v, fill) in enumerate(((g, 0), (np.where(w.grams >> (GRAM_BITS - 1), g, np.float32(0)), 0))):
        x[:, 1 + k] = _reduce(np.maximum, v, w.gram_at, fill)
    x[:, 3] = _reduce(np.add, g, w.gram_at, 0) / np.maximum(1, np.diff(w.gram_at))
    x[:, 4] = np.minimum(w.size, 20) / 20
    return x


def _reduce(how: np.ufunc, values: np.ndarray, at: np.ndarray, fill: float) -> np.ndarray:
    """values reduced from at[k] to at[k + 1]; fill where there are none."""
    out = np.full((len(at) - 1, *values.shape[1:]), fill, np.float32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = how.reduceat(values, at[some], axis=0)
    return out


def _spans(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices from at[k] to at[k + 1] for each k of which, one after the other, and where each run begins, with its end."""
    size = at[which + 1] - at[which]
    ends = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(at[which] - (ends - size), size), np.concatenate([[0], ends])


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the values of each of n rows."""
    return np.stack([np.bincount(row, v, n) for v in values.T], 1).astype(np.float32)


def word_vector_rows(w: Words) -> np.ndarray:
    return (w.word % np.uint64(WORD_VECTORS)).astype(np.int64)


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """How much more often than expected a bucket occurs in toxic documents, in units of its spread; damped."""
    expected = (toxic + clean) * (n_toxic / max(1.0, n_toxic + n_clean))
    z = (toxic - expected) / np.sqrt(expected + 1)
    return (np.sign(z) * np.log1p(np.abs(z))).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The network's weights, forward pass and gradients."""

    def __init__(self, rng: np.random.Generator):
        h, n = HIDDEN, lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {"Wx": n(INPUT, 6 * h), "bx": np.zeros(6 * h, np.float32), "U": n(2, h, 3 * h), "A": n(2 * h, 8), "a": np.zeros(8, np.float32), "v": n(8, 1)[:, 0], "w": n(2 * h, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.word_vectors = np.zeros((WORD_VECTORS, VECTOR), np.float32)
        self.gram_vectors = np.zeros((GRAM_VECTORS, VECTOR), np.float32)

    def inputs(self, w: Words, known: np.ndarray) -> np.ndarray:
        """A row of inputs for each distinct word: evidence, its vector, the mean of its n-grams' vectors."""
        grams = _reduce(np.add, self.gram_vectors[w.grams % GRAM_VECTORS], w.gram_at, 0) / np.maximum(1, np.diff(w.gram_at))[:, None]
        return np.concatenate([known, self.word_vectors[word_vector_rows(w)], grams], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What inputs add to the gates of either direction, with a last row for places beyond a text's end."""
        return np.concatenate([x @ self.p["Wx"], np.zeros((1, 6 * HIDDEN), x.dtype)]) + self.p["bx"]

    def forward(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows: index (batch, time) has rows of gates, -1 for places beyond a text's end."""
        p, h = self.p, HIDDEN
        batch, time = index.shape
        there, back = gates[:, : 3 * h], gates[:, 3 * h :]
        turned = index.T
        state = np.zeros((2, batch, h), gates.dtype)
        hs = np.empty((time, 2, batch, h), gates.dtype)
        g = np.empty((2, batch, 3 * h), gates.dtype)
        kept = []
        for t in range(time):
            g[0], g[1] = there[turned[t]], back[turned[time - 1 - t]]
            u = state @ p["U"]
            zr = _sigmoid(g[:, :, : 2 * h] + u[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            n = np.tanh(g[:, :, 2 * h :] + r * u[:, :, 2 * h :])
            if keep:
                kept.append((state, z, r, n, u[:, :, 2 * h :]))
            state = n + z * (state - n)
            hs[t] = state
        both = np.concatenate([hs[:, 0], hs[::-1, 1]], 2).transpose(1, 0, 2)
        hidden = np.tanh(both @ p["A"] + p["a"])
        s = np.where(index >= 0, hidden @ p["v"], np.float32(-1e9))
        s = np.exp(s - s.max(1, keepdims=True))
        alpha = s / s.sum(1, keepdims=True)
        c = (alpha[:, :, None] * both).sum(1)
        logit = c @ p["w"] + p["b"][0]
        return (logit, (kept, both, hidden, alpha, c)) if keep else logit

    def gradients(self, cache, x: np.ndarray, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of the inputs x (batch, time, INPUT) that gates were made of."""
        p, h = self.p, HIDDEN
        kept, both, hidden, alpha, c = cache
        batch, time, _ = x.shape
        out = {"w": c.T @ d, "b": d.sum(keepdims=True)}
        dc = d[:, None] * p["w"]
        dalpha = np.einsum("bk,btk->bt", dc, both)
        ds = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
        out["v"] = np.einsum("bt,btk->k", ds, hidden)
        du = ds[:, :, None] * p["v"] * (1 - hidden**2)
        out["A"] = np.einsum("btk,btj->kj", both, du)
        out["a"] = du.sum((0, 1))
        dboth = (alpha[:, :, None] * dc[:, None, :] + du @ p["A"].T).transpose(1, 0, 2)
        dhs = np.stack([dboth[:, :, :h], dboth[::-1, :, h:]], 1)
        dg = np.empty((time, 2, batch, 3 * h), x.dtype)
        out["U"] = np.zeros_like(p["U"])
        back = np.zeros((2, batch, h), x.dtype)
        for t in range(time - 1, -1, -1):
            before, z, r, n, un = kept[t]
            dh = dhs[t] + back
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dg[t] = np.concatenate([dz, dr, dn], 2)
            inner = np.concatenate([dz, dr, dn * r], 2)
            out["U"] += before.transpose(0, 2, 1) @ inner
            back = dh * z + inner @ p["U"].transpose(0, 2, 1)
        dg = np.concatenate([dg[:, 0], dg[::-1, 1]], 2).transpose(1, 0, 2).reshape(-1, 6 * h)
        out["Wx"], out["bx"] = x.reshape(-1, INPUT).T @ dg, dg.sum(0)
        return out, (dg @ p["Wx"].T).reshape(batch, time, INPUT)


def window_places(at: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, past-last words and texts of the windows that cover all texts with words."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // stride)) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return at[:-1][text] + nth * stride, at[1:][text], text


def take(place: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """The distinct words (batch, time) of windows; -1 beyond a text's end."""
    index = first[:, None] + np.arange(WINDOW)
    return np.where(index < past[:, None], place[np.minimum(index, len(place) - 1)], -1)


def window_logits(net: Network, gates: np.ndarray, place: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), np.float32)
    for a in range(0, len(first), _BLOCK):
        out[a : a + _BLOCK] = net.forward(gates, take(place, first[a : a + _BLOCK], past[a : a + _BLOCK]))
    return out


def summary(logit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts its largest and second largest logit (the largest again if it has one window) and the log of its windows; rows of texts without windows are 0."""
    out = np.zeros((n, 3))
    order = np.lexsort((-logit, text))
    t, v = text[order], logit[order]
    begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(t)))
    out[t[begin], 0] = v[begin]
    out[t[begin], 1] = v[np.minimum(begin + (size > 1), len(v) - 1)]
    out[t[begin], 2] = np.log(size)
    return out


@dataclass
class Model:
    net: Network
    word_table: np.ndarray
    gram_table: np.ndarray
    scale: np.ndarray  # of the summary, then a constant
    rate: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.rate)
        for first, last, data, offsets in chunks(texts):
            w = Words.of(data, offsets)
            if not len(w.place):
                continue
            begins, past, text = window_places(w.at)
            gates = self.net.gates(self.net.inputs(w, evidence_inputs(w, self.word_table, self.gram_table)))
            s = summary(window_logits(self.net, gates, w.place, begins, past), text, last - first)
            p = 1 / (1 + np.exp(-np.clip(s @ self.scale[:3] + self.scale[3], -30, 30)))
            out[first:last] = np.where(np.diff(w.at) > 0, p, self.rate)
        return out


def _calibrate(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    a = np.column_stack([s, np.ones(len(s))])
    prior, ridge = np.array([0.5, 0, 0, 0]), np.array([0.5, 1.0, 1.0, 0.1])
    c = np.array([1.0, 0.0, 0.0, 0.0])
    loss = lambda c: np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ c)).sum() + 0.5 * (ridge * (c - prior) ** 2).sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * (c - prior))
        size = 1.0
        while size > 1e-6 and loss(c - size * move) > loss(c):  # shorter where a whole step would lead away
            size /= 2
        c = c - size * move
    return c


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model | None:
    """A model from texts and their labels, 1 being toxic; None if a label is missing altogether. Repeats exactly."""
    y = np.array(labels, np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    # Texts by fold; each fold's distinct words stand once, as their evidence depends on the fold.
    fold = np.arange(len(y)) % FOLDS
    order = np.argsort(fold, kind="stable")
    y, fold, texts = y[order], fold[order], [texts[k].encode() for k in order]
    held = []
    word_counts, gram_counts = np.zeros((FOLDS, 2, 1 << WORD_BITS)), np.zeros((FOLDS, 2, 1 << GRAM_BITS))
    for f in range(FOLDS):
        mine = [t for t, g in zip(texts, fold, strict=True) if g == f]
        w = Words.of(np.frombuffer(b"".join(mine), np.uint8), np.cumsum([0, *map(len, mine)]))
        held.append(w)
        for k, v in enumerate(y[fold == f]):  # each bucket counts once a document
            own = np.unique(w.place[w.at[k] : w.at[k + 1]])
            word_counts[f, v, np.unique(w.word[own] >> np.uint64(64 - WORD_BITS)).astype(np.int64)] += 1
            gram_counts[f, v, np.unique(w.grams[_spans(w.gram_at, own)[0]])] += 1
    n = np.array([[((fold == f) & (y == v)).sum() for v in (0, 1)] for f in range(FOLDS)])

    def tables(without: int | None):
        use = [f for f in range(FOLDS) if f != without]
        w, g, m = word_counts[use].sum(0), gram_counts[use].sum(0), n[use].sum(0)
        return evidence(w[1], w[0], m[1], m[0]), evidence(g[1], g[0], m[1], m[0])

    known = np.concatenate([evidence_inputs(w, *tables(f)) for f, w in enumerate(held)])
    base, places, grams = (np.cumsum([0, *(len(v) for v in vs)]) for vs in zip(*((w.word, w.place, w.grams) for w in held), strict=True))
    at = np.concatenate([*(w.at[:-1] + b for w, b in zip(held, places, strict=False)), places[-1:]])
    all_words = Words(
        np.concatenate([w.place + b for w, b in zip(held, base, strict=False)]), at, np.concatenate([w.word for w in held]), np.concatenate([w.size for w in held]),
        np.concatenate([w.grams for w in held]), np.concatenate([*(w.gram_at[:-1] + b for w, b in zip(held, grams, strict=False)), grams[-1:]]),
    )
    del held
    place = all_words.place
    first, past, owner = window_places(at, TRAIN_STRIDE)
    if not len(first):
        return None
    net = Network(rng)
    rows = word_vector_rows(all_words)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    seen = [np.full_like(net.word_vectors, 1e-3), np.full_like(net.gram_vectors, 1e-3)]
    # At first a window's rank is what its words and grams say; later the network says it.
    word_rank = known[:, :3].max(1)
    rank = np.array([word_rank[place[a : min(a + WINDOW, b)]].max() for a, b in zip(first, past, strict=True)])
    step = 0
    for turn in range(4):
        best = summary(rank.astype(np.float32), owner, len(y))
        toxic = np.flatnonzero((y[owner] == 1) & (rank >= best[owner, 0] - 1e-6))
        clean = np.flatnonzero(y[owner] == 0)
        hard = np.flatnonzero((y[owner] == 0) & (rank >= best[owner, 0] - 1e-6))
        for _ in range(STEPS // 4):
            step += 1
            half = BATCH // 2
            pick = np.concatenate([rng.choice(toxic, half), rng.choice(hard, half // 2), rng.choice(clean, half - half // 2)])
            index = take(place, first[pick], past[pick])
            use, where = np.unique(index, return_inverse=True)
            use, where = (use[1:], where.reshape(index.shape) - 1) if use[0] < 0 else (use, where.reshape(index.shape))
            span, span_at = _spans(all_words.gram_at, use)
            part = Words(where, at, all_words.word[use], all_words.size[use], all_words.grams[span], span_at)
            x = net.inputs(part, known[use])
            drop = (rng.random((len(use), 2)) < DROP).repeat(VECTOR, 1)
            x[:, EVIDENCE:][drop] = 0
            logit, cache = net.forward(net.gates(x), where, keep=True)
            want = y[owner[pick]].astype(np.float32)
            d = ((_sigmoid(logit) - want) / len(pick)).astype(np.float32)
            rate = 0.02 * min(1.0, step / 20) * (0.3 if turn == 3 else 1.0)
            grads, dx = net.gradients(cache, np.where((where >= 0)[:, :, None], x[where], np.float32(0)), d)
            for k, grad in grads.items():
                grad = grad + 1e-4 * net.p[k]
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[k] = (net.p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            dw = _sums(where[where >= 0], dx[where >= 0][:, EVIDENCE:], len(use))
            dw[drop] = 0
            size = np.diff(span_at)
            for vectors, acc, row, g in ((net.word_vectors, seen[0], rows[use], dw[:, :VECTOR]), (net.gram_vectors, seen[1], part.grams % GRAM_VECTORS, np.repeat(dw[:, VECTOR:] / np.maximum(1, size)[:, None], size, 0))):
                which, back = np.unique(row, return_inverse=True)
                total = _sums(back, g, len(which)) + np.float32(1e-4) * vectors[which]
                acc[which] += total * total
                vectors[which] -= 0.5 * rate * total / np.sqrt(acc[which])
        gates = net.gates(net.inputs(all_words, known))
        if turn == 3:
            first, past, owner = window_places(at)
        rank = window_logits(net, gates, place, first, past)
    s = summary(rank, owner, len(y))
    has = np.bincount(owner, minlength=len(y)) > 0
    return Model(net, *tables(None), _calibrate(s[has], y[has].astype(float)), float(y.mean()))


def held_out(doc_id):
    """Whether a row's labels may not be learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the rows that are learnt from: bounded by TOXIC_ROWS, CLEAN_ROWS and TRAIN_CHARS."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = None
    for value, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        some = marks.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        pick = some if pick is None else pick.union(some)
    short = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= TRAIN_CHARS)
    return short.join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def fitted(docs: DataFrame, labels: DataFrame) -> bytes:
    """The pickled model (or None) that one task makes of the bounded sample; the driver never sees a text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        # By a hash of the id, so that folds don't follow the order of ids.
        got.sort(key=lambda r: hashes(np.frombuffer(str(r[0]).encode(), np.uint8), np.array([0]), np.array([len(str(r[0]))]), False)[0])
        model = train([r[1] for r in got], [r[2] for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = sample(docs, labels).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.dumps(None) if made is None else made[0]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from a bounded sample of labelled documents that aren't held out."""
    return pickle.loads(fitted(docs, labels))  # noqa: S301


def score_documents(docs: DataFrame, model: bytes, name: str = "toxicity") -> DataFrame:
    """docs with a last column ``name``, double: the score of each whole text by a pickled model. Narrow."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(bytes(model))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(sent.value)  # noqa: S301
        for batch in batches:
            s = net.scores(batch.column(where)) if net is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below THRESHOLD."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text").cast("string").alias("text"))
    return score_documents(rows, fitted(docs, labels)).where(F.col("toxicity") < THRESHOLD).select("_row.*")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs.select("doc_id", "text"), fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
