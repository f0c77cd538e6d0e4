"""Operator 7: toxicity by a bidirectional gated recurrent network with attention pooling.

A text is a sequence of words; each word enters the network through a word input
(how much more often that word stands in toxic texts) and character inputs (the
same for its first 4, 5 and 7 bytes and, the largest over the word, for its
6-byte pieces, so that unseen forms of a word are known by their parts), plus
its length. Two
gated recurrent layers read a window in both directions, an attention layer
weighs the states, and a logistic unit scores the weighted sum. All overlapping
windows of the whole text are scored; the text takes the largest score.

Training is numpy with back-propagation through time, in one task on a bounded sample of
labelled rows: ``per_class`` documents of each class, chosen by hash, those of up
to ``most_chars`` characters before longer ones. A longer text trains on PIECES_OF
pieces at hash-chosen places over its whole length, ``most_chars`` in all. A training text's inputs come from counts that leave out its
own tenth of the sample, so the network learns from inputs as unseen texts have
them. Labels say nothing about windows: a text trains through its strongest
window, chosen anew during training, and a clean one also through another.

Scoring needs no shuffle; a task works in runs of half a megabyte of text.

Defined results: a null or wordless text takes the sample's share of toxic rows,
at most 0.49; without labelled rows every score is 0, and with one class every
score is that share, as it is without labelled documents. If only one of two
labelled classes has documents, that is an error. Labels repeated for an id count once, toxic if any is.
Repeated rows give repeated results; extra columns pass through ``score``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import textops

WINDOW, STRIDE = 48, 32
PER_CLASS, MOST_CHARS, PIECES_OF = 600, 20_000, 8
HIDDEN, ATTENTION, INPUTS = 8, 8, 6
BUCKETS = 1 << 16
#: Character pieces of a word: its first so many bytes, or each run of so many.
PIECES = (("first", 4), ("first", 5), ("first", 7), ("each", 6))
SMOOTH = 4.0
RUN_BYTES = 1 << 19
BATCH = 2048


@dataclass
class Words:
    """Distinct words of a run of texts and, for each text, its words by number."""

    hashes: np.ndarray
    lengths: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    texts: list[np.ndarray]


def words_of(texts: list[str]) -> Words:
    """Words of texts and their pieces: for each piece length, (word number, bucket) pairs."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(t) + 1 for t in raw])
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    starts, hashes = textops.word_hashes(buf, textops.MARKS, False)
    cut = np.searchsorted(starts, offsets)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    gap = np.flatnonzero(textops.MARKS[buf])
    ends = gap[np.searchsorted(gap, starts)] if len(starts) else starts
    size = (ends - starts)[first]
    begin = starts[first]
    padded = np.concatenate((buf, np.zeros(16, np.uint8)))
    grams = []
    for j, (kind, n) in enumerate(PIECES):
        # A word shorter than the piece is its own piece.
        count = np.maximum(size - n + 1, 1) if kind == "each" else np.ones(len(distinct), np.int64)
        who = np.repeat(np.arange(len(distinct)), count)
        at = np.repeat(begin, count) + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        span = np.minimum(size, n)[who]
        key = span.astype(np.uint64)
        for i in range(n):
            key = key * np.uint64(0x100000001B3) + np.where(i < span, padded[at + i], np.uint8(0)).astype(np.uint64)
        grams.append((who, (textops.mix(key + np.uint64(j << 8)) >> np.uint64(48)).astype(np.int64)))
    return Words(distinct, size, grams, [number[cut[i] : cut[i + 1]] for i in range(len(texts))])


def _slots(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    own = (np.arange(len(words.hashes)), (words.hashes >> np.uint64(48)).astype(np.int64))
    return [own, *words.grams]


def counts(words: Words) -> list[list[np.ndarray]]:
    """For each text, the distinct buckets of its words and of its pieces of each length."""
    order = []
    for who, bucket in _slots(words):
        start = np.searchsorted(who, np.arange(len(words.hashes) + 1))
        order.append((start, bucket))
    out = []
    for text in words.texts:
        seen = np.unique(text)
        out.append([np.unique(np.concatenate([bucket[start[w] : start[w + 1]] for w in seen])) if len(seen) else np.zeros(0, np.int64) for start, bucket in order])
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Smoothed log ratio of a bucket's share among toxic and among clean texts; 0 for an unseen bucket."""
    a1 = SMOOTH * n_toxic / max(1, n_toxic + n_clean)
    a0 = SMOOTH - a1
    return np.log((toxic + a1) / (n_toxic + a1 + 1e-9) * (n_clean + a0 + 1e-9) / (clean + a0)).astype(np.float32)


def inputs(words: Words, tables: list[np.ndarray]) -> np.ndarray:
    """Input vector of each distinct word, and a row of zeros for padding."""
    n = len(words.hashes)
    x = np.zeros((n + 1, INPUTS), np.float32)
    if n:
        slots = _slots(words)
        x[:n, 0] = tables[0][slots[0][1]]
        for j, (who, bucket) in enumerate(slots[1:]):
            value = tables[j + 1][bucket]
            start = np.searchsorted(who, np.arange(n))
            x[:n, 1 + j] = np.maximum.reduceat(value, start)
        x[:n, 5] = np.minimum(words.lengths, 16) / 8.0 - 1
    return x


def windows(texts: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of every overlapping window (rows of WINDOW, padded) and the text of each."""
    rows, owner = [], []
    for i, text in enumerate(texts):
        if n := len(text):
            k = 1 + max(0, -(-(n - WINDOW) // STRIDE))
            filled = np.full((k - 1) * STRIDE + WINDOW, pad, np.int32)
            filled[:n] = text
            rows.append(np.lib.stride_tricks.sliding_window_view(filled, WINDOW)[::STRIDE])
            owner.append(np.full(k, i))
    if not rows:
        return np.zeros((0, WINDOW), np.int32), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Net:
    """Weights: ``wx`` inputs and ``wh`` states to gates (z, r, candidate) in both directions, attention, output."""

    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    wa: np.ndarray
    va: np.ndarray
    u: np.ndarray
    c: np.ndarray

    @staticmethod
    def fresh(seed: int) -> Net:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.normal(size=s) * 0.3).astype(np.float32)
        return Net(g(2, INPUTS, 3 * HIDDEN), g(2, HIDDEN, 3 * HIDDEN), np.zeros((2, 1, 3 * HIDDEN), np.float32), g(2 * HIDDEN, ATTENTION), g(ATTENTION), g(2 * HIDDEN), np.zeros(1, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b, self.wa, self.va, self.u, self.c]

    def run(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows; x holds a vector for each word number, the last one padding."""
        n, steps = index.shape
        pad = len(x) - 1
        gates = np.matmul(x[None], self.wx) + self.b  # a row for each distinct word and direction
        both = np.stack((index, index[:, ::-1]))
        live = (both != pad).astype(np.float32)[..., None]
        h = np.zeros((2, n, HIDDEN), np.float32)
        states, trace = np.empty((2, n, steps, HIDDEN), np.float32), []
        ways = np.arange(2)[:, None]
        for t in range(steps):
            g = gates[ways, both[:, :, t]]
            a = np.matmul(h, self.wh[..., : 2 * HIDDEN])
            zr = _sigmoid(g[..., : 2 * HIDDEN] + a)
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            m = np.tanh(g[..., 2 * HIDDEN :] + np.matmul(r * h, self.wh[..., 2 * HIDDEN :]))
            new = h + live[:, :, t] * z * (m - h)
            if keep:
                trace.append((h, z, r, m))
            h = new
            states[:, :, t] = h
        s = np.concatenate((states[0], states[1][:, ::-1]), -1)
        e = np.tanh(s @ self.wa)
        score = np.where(index != pad, e @ self.va, -1e9)
        alpha = np.exp(score - score.max(1, keepdims=True))
        alpha /= alpha.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", alpha, s)
        logit = pooled @ self.u + self.c[0]
        return (logit, (both, live, trace, s, e, alpha, pooled)) if keep else logit

    def gradients(self, x: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted logistic loss, in the order of :meth:`params`."""
        logit, (both, live, trace, s, e, alpha, pooled) = self.run(x, index, keep=True)
        d = ((_sigmoid(logit) - y) * weight).astype(np.float32)
        du, dc = pooled.T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * self.u
        ds = alpha[..., None] * dp[:, None]
        da = np.einsum("nth,nh->nt", s, dp)
        dscore = alpha * (da - (alpha * da).sum(1, keepdims=True))
        de = dscore[..., None] * self.va * (1 - e * e)
        dva = np.einsum("nta,nt->a", e, dscore)
        dwa = np.einsum("nth,nta->ha", s, de)
        ds += de @ self.wa.T
        back = np.stack((ds[..., :HIDDEN], ds[:, ::-1, HIDDEN:]))
        dwx, dwh, db = np.zeros_like(self.wx), np.zeros_like(self.wh), np.zeros_like(self.b)
        dh = np.zeros_like(trace[0][0])
        w1, w2 = self.wh[..., : 2 * HIDDEN], self.wh[..., 2 * HIDDEN :]
        for t in range(len(trace) - 1, -1, -1):
            h, z, r, m = trace[t]
            dh = dh + back[:, :, t]
            on = live[:, :, t]
            dm = dh * on * z * (1 - m * m)
            dz = dh * on * (m - h) * z * (1 - z)
            dn = np.matmul(dm, w2.transpose(0, 2, 1))
            dr = dn * h * r * (1 - r)
            dg = np.concatenate((dz, dr, dm), -1)
            dwx += np.matmul(x[both[:, :, t]].transpose(0, 2, 1), dg)
            db += dg.sum(1, keepdims=True)
            dwh[..., : 2 * HIDDEN] += np.matmul(h.transpose(0, 2, 1), dg[..., : 2 * HIDDEN])
            dwh[..., 2 * HIDDEN :] += np.matmul((r * h).transpose(0, 2, 1), dm)
            dh = dh * (1 - on * z) + dn * r + np.matmul(dg[..., : 2 * HIDDEN], w1.transpose(0, 2, 1))
        return [dwx, dwh, db, dwa, dva, du, dc]


@dataclass
class Model:
    """The network, its input tables and the sample's share of toxic rows."""

    prior: float
    net: Net | None = None
    tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Score of each text: the largest over its windows."""
        out = np.full(len(texts), min(self.prior, 0.49))
        if self.net is None:
            return np.full(len(texts), self.prior)
        words = words_of(texts)
        x = inputs(words, self.tables)
        index, owner = windows(words.texts, len(x) - 1)
        best = np.full(len(texts), -np.inf)
        for a in range(0, len(index), BATCH):
            np.maximum.at(best, owner[a : a + BATCH], self.net.run(x, index[a : a + BATCH]))
        seen = np.isfinite(best)
        out[seen] = _sigmoid(best[seen])
        return out


def train(texts: list[str], labels: list[int], share: float | None = None, epochs: int = 8, seed: int = 5, rate: float = 0.02) -> Model:
    """Fit tables and network on a sample of texts; ``share`` is that of toxic texts among all, if the sample's differs."""
    y = np.array(labels, np.float32)
    prior = share if share is not None else float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(prior)
    rng = np.random.default_rng(seed)
    words = words_of(texts)
    seen, tenth = counts(words), rng.integers(0, 10, len(texts))

    def tally(rows: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros((2, BUCKETS)) for _ in range(1 + len(PIECES))]
        for i in rows:
            for table, buckets in zip(out, seen[i], strict=True):
                table[int(y[i]), buckets] += 1
        return out

    parts = [tally(np.flatnonzero(tenth == f)) for f in range(10)]
    total = [sum(p[j] for p in parts) for j in range(1 + len(PIECES))]
    tables = [log_odds(t[1], t[0], int(y.sum()), int((1 - y).sum())) for t in total]

    # Windows by text; each tenth has inputs from the other tenths' counts.
    n = len(words.hashes)
    xs, rows, owner = [], [], []
    for f in range(10):
        own = tenth == f
        left = [t - p for t, p in zip(total, parts[f], strict=True)]
        odds = [log_odds(t[1], t[0], int(y[~own].sum()), int((1 - y[~own]).sum())) for t in left]
        xs.append(inputs(words, odds))
        index, who = windows([words.texts[i] if own[i] else words.texts[i][:0] for i in range(len(texts))], n)
        rows.append((index, np.full(len(who), f)))
        owner.append(who)
    x = np.concatenate([v[:n] for v in xs] + [xs[0][n:]])
    pad = len(x) - 1
    index = np.concatenate([np.where(r == n, np.int32(pad), r + (f[:, None] * n).astype(np.int32)) if len(r) else r for r, f in rows])
    del rows
    owner = np.concatenate(owner)
    if not len(index):
        return Model(prior)

    net = Net.fresh(seed)
    strength = x[index, :5].sum(2).max(1)  # before there is a network: the strongest word
    means, squares = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    step, per_class = 0, {c: 0.5 / max(1, (y == c).sum()) for c in (0, 1)}
    for epoch in range(epochs):
        if epoch in (2, 5):
            strength = np.concatenate([net.run(x, index[a : a + BATCH]) for a in range(0, len(index), BATCH)])
        order = np.lexsort((strength, owner))
        last = np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True))
        top = order[last]
        other = rng.permutation(len(index))
        other = other[y[owner[other]] == 0][: (y == 0).sum()]
        chosen = rng.permutation(np.concatenate((top, other)))
        for a in range(0, len(chosen), 64):
            at = chosen[a : a + 64]
            target = y[owner[at]]
            weight = np.where(target == 1, per_class[1], per_class[0] / 2) * len(y) / len(at)
            step += 1
            for p, m, v, g in zip(net.params(), means, squares, net.gradients(x, index[at], target, weight), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * 0.85**epoch) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    net.c += np.float32(np.log(prior / (1 - prior)))  # both classes weighed the same in training
    return Model(prior, net, tables)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Model:
    """Fit on labelled rows; the caller has left out the held-out ones from ``labels`` (doc_id, toxic)."""
    one = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    many = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}  # two rows at most
    # The sample is drawn from labelled documents, so neither missing ids nor long texts can empty a class.
    h = F.xxhash64("doc_id")
    known = docs.filter(F.col("text").isNotNull()).select("doc_id", (F.length("text") > most_chars).alias("long")).join(one, "doc_id")
    order = Window.partitionBy("toxic").orderBy("long", h, "doc_id")
    picked = known.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_class).select("doc_id", "toxic").distinct()
    length, piece = F.length("text"), most_chars // PIECES_OF
    start = lambda i: F.floor((i + F.pmod(F.xxhash64("doc_id", i), F.lit(1000)) / 1000) / PIECES_OF * (length - piece)).cast("int") + 1
    pieces = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(PIECES_OF - 1)), lambda i: F.substring("text", start(i), F.lit(piece))))
    rows = docs.select("doc_id", F.when(length <= most_chars, F.col("text")).otherwise(pieces).alias("text")).join(F.broadcast(picked), "doc_id")  # 2 * per_class rows
    known = rows.filter(F.col("text").isNotNull()).select("toxic", h.alias("h"), "doc_id", "text")
    order = ("toxic", "h", "doc_id", "text")
    first = [known.filter(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    share = many.get(1, 0) / max(1, sum(many.values()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        labels: list[int] = []
        for batch in batches:
            texts += batch.column(3).to_pylist()
            labels += batch.column(0).to_pylist()
        model = train(texts, labels, share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary()), pa.array([labels.count(0)]), pa.array([labels.count(1)])], names=["model", "clean", "toxic"])

    # One task of the sample's bounded rows trains, so the driver holds neither texts nor windows.
    sample = first[0].union(first[1]).repartition(1).sortWithinPartitions(*order)
    got = sample.mapInArrow(learn, "model binary, clean long, toxic long").collect()
    if not got or not got[0]["clean"] + got[0]["toxic"]:
        return train([], [], share)
    if lost := [c for c, n in ((0, got[0]["clean"]), (1, got[0]["toxic"])) if c in many and not n]:
        raise ValueError(f"no document of the labelled class {lost[0]}")
    return pickle.loads(got[0]["model"])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) to every row."""
    kept = [c for c in docs.columns if c != "score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType(list(docs.schema.fields)).add("score", "double")
    shared, at = docs.sparkSession.sparkContext.broadcast(model), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            out, first, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= RUN_BYTES or i == len(texts) - 1:
                    out.append(model.scores(texts[first : i + 1]))
                    first, size = i + 1, 0
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)
