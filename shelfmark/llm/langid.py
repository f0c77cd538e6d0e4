"""Operator 5: language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over
hashed byte n-grams (2 to 4 bytes of the lower-cased text) is fitted; a text's
bit margins are decoded to the codeword with the least loss, where a bit's loss
counts by how well that bit's classifier separates that language in training
(loss-weighted decoding). Up to seven languages take the exhaustive code, more
take the best of several random dense codes. A text whose two best codewords are
closer than ``ambiguous_margin`` is flagged.

Fitting uses a bounded sample (``per_lang`` texts of each language, chosen by
hash, and a short piece of each, so that short texts are known too). Features of
the sample are computed by tasks, and one task trains on its ``per_lang`` *
languages * 2 vectors; the driver sees the model alone. Prediction walks every
whole text in tasks, without a shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0;
without any labelled text, every text is ``und``; with one language, it is
predicted with score 1. A null doc_id counts as the text "" in the fold rule.
Repeated rows give repeated results; extra columns pass through ``predict``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import textops

UNDETERMINED = "und"
DIM = 4096
#: Texts of each language that are learnt from, and the most vectors of all together (two a text).
PER_LANG, MOST_VECTORS = 400, 24_576
AMBIGUOUS_MARGIN = 0.05
#: Columns of the sample's vectors that are put in order at once.
SORTED_COLUMNS = 256
PAD = b"    "
#: A task predicts texts in runs of about so many characters, and so many texts at most.
RUN_CHARS, RUN_TEXTS = 1 << 17, 64
_LETTER = regex.compile(r"\p{L}")


def features(texts: list[bytes]) -> np.ndarray:
    """Hashed counts of 2- to 4-byte n-grams, square-rooted and of unit length: a row for each text.

    Every text lies between blanks of its own, so no n-gram reaches into another text.
    """
    buf = np.frombuffer(b"".join(PAD + t + PAD for t in texts) + PAD, np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) + 2 * len(PAD) for t in texts])
    a, b, c, d = (buf[i : len(row) + i] for i in range(4))
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    three = two + c * np.uint32(0xC2B2AE3D)
    four = three + d * np.uint32(0x27D4EB2F)
    out = np.zeros(len(texts) * DIM)
    for g, salt in ((two, 0x3C6EF372), (three, 0xDAA66D2B), (four, 0x78DDE6E4)):
        g = g ^ np.uint32(salt)
        g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out += np.bincount(row * DIM + (g >> np.uint32(20)), minlength=len(out))
    x = np.sqrt(out.reshape(len(texts), DIM).astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of k languages."""
    if k <= 7:
        bits = [[1 if (j >> r) & 1 else -1 for r in range(k)] for j in range(1, 1 << (k - 1))]
        return np.array(bits, np.float32).reshape(-1, k).T
    rng, best, most = np.random.default_rng(seed), None, -1
    n = int(np.ceil(10 * np.log2(k)))
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (k, n)).astype(np.float32)
        code = code[:, np.abs(code.sum(0)) < k]
        agree = code @ code.T
        np.fill_diagonal(agree, -n)
        if (gap := code.shape[1] - agree.max()) > most:
            best, most = code, gap
    return best


@dataclass
class Model:
    """Bit classifiers, codewords and the weight of each bit for each language."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score and the gap of the loss to the second, for each row of features."""
        if len(self.langs) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.full(len(x), np.inf)
        z = x.astype(np.float64) @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -z * c) * t).sum(1) for c, t in zip(self.code, self.trust, strict=True)], 1)
        ordered = np.sort(loss, 1)
        p = np.exp(ordered[:, :1] - loss)
        return loss.argmin(1), 1 / p.sum(1), ordered[:, 1] - ordered[:, 0]


def train(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 80, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """Fit all bits at once by logistic regression (Adam, full batches, classes of equal weight)."""
    k = len(langs)
    code = codewords(k) if k > 1 else np.zeros((1, 0), np.float32)
    target = code[y]
    share = (1 / np.bincount(y, minlength=k).clip(1))[y][:, None].astype(np.float32) / k
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * share
        for p, m, v, d in ((w, mw, vw, x.T @ g + decay * w), (b, mb, vb, g.sum(0))):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    right = ((x @ w + b) * target > 0).astype(np.float32)
    trust = np.stack([right[y == r].mean(0) if (y == r).any() else np.full(code.shape[1], 0.5) for r in range(k)])
    trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-9)
    return Model(langs, code, w, b, trust.astype(np.float32))


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of each text and of a short piece of it, as half floats."""
    for batch in batches:
        for lang, text, spot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.split()
            at = spot % max(1, len(words))
            piece = " ".join(words[at : at + 3 + spot // 7 % 10])
            x = features([_lowered(text), _lowered(piece)])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * 2), pa.array([r.astype(np.float16).tobytes() for r in x])], names=["lang", "x"])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", per_lang: int = PER_LANG, most_vectors: int = MOST_VECTORS) -> Model | None:
    """Fit on the labelled rows of ``docs``; the caller has left out the held-out ones.

    Many languages share ``most_vectors``; each keeps two texts at least.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Texts count once, however often they are repeated.
    h = F.xxhash64("text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).collect()}  # a row a language
    if not counts:
        return None
    langs = sorted(counts)
    per_lang = max(2, min(per_lang, most_vectors // (2 * len(langs))))
    # A hash-chosen share of each language leaves about 1.5 * per_lang texts of it, of which per_lang stay.
    shares = docs.sparkSession.createDataFrame([(name, min(1.0, (1.5 * per_lang + 50) / max(1, n))) for name, n in counts.items()], "lang string, share double")
    picked = rows.join(F.broadcast(shares), "lang").withColumn("h", h).filter(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    picked = picked.dropDuplicates(["lang", "h"]).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= per_lang)
    vectors = picked.select("lang", "text", F.pmod(F.hash("text"), F.lit(1 << 20)).cast("long").alias("spot")).mapInArrow(_featurised, "lang string, x binary")
    number = {name: i for i, name in enumerate(langs)}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.empty((2 * per_lang * len(langs), DIM), np.float32), []
        for batch in batches:
            for name, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x[len(y)] = np.frombuffer(vector.as_buffer(), np.float16)
                y.append(number[name])
        x, y = x[: len(y)], np.array(y)
        order = np.lexsort((x @ np.arange(DIM, dtype=np.float32), y))  # rows arrive in no set order
        for a in range(0, DIM, SORTED_COLUMNS):
            x[:, a : a + SORTED_COLUMNS] = x[order, a : a + SORTED_COLUMNS]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(x, y[order], langs))], pa.binary())], names=["model"])

    # One task of the sample's bounded rows trains, so the driver holds no vectors.
    (trained,) = vectors.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(trained["model"])


def _named(model: Model | None, texts: list, ambiguous_margin: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text, in runs of bounded size."""
    lang, score, vague = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    run, size = [], 0
    for i, t in enumerate([*texts, None]):
        if model and t and _LETTER.search(t):
            run.append(i)
            size += len(t)
        if run and (size >= RUN_CHARS or len(run) >= RUN_TEXTS or i == len(texts)):
            best, p, gap = model.decode(features([_lowered(texts[j]) for j in run]))
            for j, b in zip(run, best, strict=True):
                lang[j] = model.langs[b]
            score[run], vague[run] = p, gap < ambiguous_margin
            run, size = [], 0
    return lang, score, vague


def predict(docs: DataFrame, model: Model | None, text: str = "text", ambiguous_margin: float = AMBIGUOUS_MARGIN) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``ambiguous`` to every row."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    shared, at = docs.sparkSession.sparkContext.broadcast(model), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in textops.pieces(b, at)):
            lang, score, vague = _named(shared.value, batch.column(at).to_pylist(), ambiguous_margin)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score), pa.array(vague)], names=schema.names)

    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model | None, text: str = "text", ambiguous_margin: float = AMBIGUOUS_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose text has a language that is not ambiguous, with all their columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in textops.pieces(b, at)):
            lang, _, vague = _named(shared.value, batch.column(at).to_pylist(), ambiguous_margin)
            yield batch.filter(pa.array([name != UNDETERMINED and not v for name, v in zip(lang, vague, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
