import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import langid, neighbours, toxicity

SYLLABLES = {"en": "the ing and tion er on", "de": "sch ung und keit ein ber", "fr": "eau tion ouè les eux ç", "es": "ción os ña que las ar"}


def prose(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))


def labelled(spark, langs=("en", "de", "fr", "es"), n=60):
    rng = random.Random(2)
    rows = [(i, prose(rng, langs[i % len(langs)], rng.randrange(5, 60)), langs[i % len(langs)]) for i in range(n * len(langs))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_accuracy_and_undetermined(spark):
    docs = labelled(spark)
    model = langid.fit(docs.filter("doc_id % 5 <> 0"))  # 4 would part the languages
    assert model.code.shape == (4, 7)
    out = langid.predict(docs.filter("doc_id % 5 = 0"), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95 and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "é")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}.keys() == {1, 2, 3, 4}
    assert [r.lang_pred for r in langid.predict(odd.filter("doc_id < 4"), model).collect()] == ["und"] * 3


def test_language_prediction_stands_alone(spark):
    """A text's result doesn't depend on its neighbours in a batch."""
    docs = labelled(spark, n=15)
    model = langid.fit(docs)
    key = lambda df: {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in langid.predict(df, model).collect()}
    assert key(docs.coalesce(1)) == key(docs.repartition(7))


def test_language_messy(spark, messy, none):
    model = langid.fit(messy)
    out = langid.predict(messy, model)
    assert out.columns == [c for c in messy.columns if c != "score"] + ["lang_pred", "score", "ambiguous"] and out.count() == messy.count()
    assert langid.fit(none) is None and langid.predict(none, None).count() == 0
    assert {r.lang_pred for r in langid.predict(messy, None).collect()} == {"und"}
    single = langid.fit(labelled(spark, ("en",), 5))
    assert {(r.lang_pred, r.score) for r in langid.predict(labelled(spark, ("en",), 5), single).collect()} == {("en", 1.0)}


def test_language_model_is_trained_in_a_task(spark, monkeypatch):
    """The driver gets no vectors, and the model doesn't depend on how rows are dealt."""
    train = langid.train

    def told(x, y, langs):
        model = train(x, y, langs)
        model.process, model.sample = os.getpid(), (x.shape, np.bincount(y).tolist())
        return model

    monkeypatch.setattr(langid, "train", told)
    docs = labelled(spark, n=20)
    models = [langid.fit(d) for d in (docs.coalesce(1), docs.repartition(7))]
    assert all(m.process != os.getpid() and m.sample == ((160, langid.DIM), [40] * 4) for m in models)
    assert np.allclose(models[0].weights, models[1].weights, atol=1e-6) and np.array_equal(models[0].trust, models[1].trust)


def test_many_languages_take_random_codes():
    code = langid.codewords(12)
    agree = code @ code.T
    np.fill_diagonal(agree, -1)
    assert len(code) == 12 and (code.shape[1] - agree.max()) / 2 >= 5


def toxic_docs(n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words, bad = prose(rng, "en", rng.randrange(3, 200)).split(), i % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["scum", "idiot", f"vex{rng.choice(['ing', 'tion', 'er', 'on'])}"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Net.fresh(1)
    for p in net.params():
        p[...] = rng.normal(size=p.shape) * 0.3
    x = np.concatenate((rng.normal(size=(9, toxicity.INPUTS)), np.zeros((1, toxicity.INPUTS)))).astype(np.float32)
    index = rng.integers(0, 9, (5, toxicity.WINDOW))
    index[3, 4:] = 9
    y, w = np.array([1, 0, 1, 0, 1.0]), np.ones(5)

    def loss():
        z = net.run(x, index).astype(float)
        return float((np.logaddexp(0, z) - y * z).sum())

    for p, g in zip(net.params(), net.gradients(x, index, y, w), strict=True):
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_toxicity_held_out_accuracy(spark):
    rows = toxic_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.filter("doc_id % 3 <> 1").select("doc_id", "toxic"))
    out = toxicity.score(docs, model).filter("doc_id % 3 = 1").collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in out) / len(out)
    assert right > 0.9
    tail = spark.createDataFrame([(1, "the ing and " * 20_000 + "scum idiot scum")], "doc_id long, text string")
    assert toxicity.score(tail, model).first().score >= 0.5  # the end of a long text counts


def test_toxicity_messy(spark, messy, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(messy, labels)
    out = toxicity.score(messy, model)
    rows = out.collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.text is None or not r.text.strip()} == {min(model.prior, 0.49)}
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(messy, labels.limit(0)).scores(["a", ""]).tolist() == [0.0, 0.0]
    assert toxicity.fit(messy, labels.filter("toxic = 1")).scores(["a"]).tolist() == [1.0]


def brute_nearest(vectors, k):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    out = {}
    for i, v in vectors:
        if i % 20 == 0:
            s = (x * np.array(v, float)).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vectors = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1200)]
    usable = neighbours.usable(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    stored = [(r.vec_id, r.v) for r in usable.collect()]
    truth = brute_nearest(stored, 20)
    found = {}
    for r in neighbours.search(usable, usable.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == truth.keys() and all(len(v) == 20 for v in found.values())
    recall = np.mean([len({a for a, _ in found[q]} & {a for a, _ in truth[q]}) / 20 for q in truth])
    exact = dict(stored)
    assert recall >= 0.9
    assert all(s == (np.array(exact[q]) * np.array(exact[v])).sum() for q, rows in found.items() for v, s in rows)


def test_neighbours_ties_and_unusable(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, None), (120, [0.0, 0.0]), (140, [1.0, None]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0]), (200, [1.0]), (None, [1.0, 1.0])]
    usable = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = neighbours.search(usable, usable.filter("vec_id % 20 = 0")).collect()
    assert {r.query_id for r in out} == {0, 20, 40, 200}  # a shorter vector counts as filled up with zeros
    assert sorted(r.vec_id for r in out if r.query_id == 0) == list(range(1, 21))
    few = usable.filter("vec_id < 3")
    assert sorted(r.vec_id for r in neighbours.search(few, few.filter("vec_id = 0")).collect()) == [1, 2]
    assert neighbours.search(usable.limit(0), usable.limit(0)).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    label = neighbours.balanced_parts(x, neighbours.nearest(x, 8), 6)
    assert np.bincount(label, minlength=6).max() <= 110 + 1


def test_fold_rule(spark):
    import zlib

    rows = spark.range(50).select("id", langid.fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_long_texts_train_too(spark):
    """All toxic texts are longer than the bound: their pieces stand for them."""
    rng = random.Random(9)
    rows = [(i, t if not bad else " ".join(t.split() + (["scum", "idiot"] + t.split()[:6]) * 40), bad) for i, t, bad in toxic_docs(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), most_chars=1_200)
    assert model.net is not None
    bad, good = model.scores([" ".join("scum idiot " + prose(rng, "en", 6) for _ in range(8)), prose(rng, "en", 40)])
    assert bad > 0.5 > good
    with pytest.raises(ValueError):
        toxicity.fit(docs.filter("toxic = 0"), docs.select("doc_id", "toxic"))
    assert toxicity.fit(docs.limit(0), docs.select("doc_id", "toxic")).net is None


def plain_score(model, text):
    """The largest window score of a text, word by word and step by step."""
    raw = text.lower().encode()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", raw)
    net, n = model.net, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    def entry(word):
        one = toxicity.words_of([word.decode()])
        return toxicity.inputs(one, model.tables)[0].astype(float)

    xs = [entry(w) for w in words]
    best, at = -np.inf, 0
    while True:
        window = xs[at : at + toxicity.WINDOW]
        states = []
        for way, order in ((0, window), (1, window[::-1])):
            h, out = np.zeros(n), []
            for x in order:
                g = x @ net.wx[way] + net.b[way, 0]
                a = h @ net.wh[way][:, : 2 * n]
                z, r = sigmoid(g[:n] + a[:n]), sigmoid(g[n : 2 * n] + a[n:])
                m = np.tanh(g[2 * n :] + (r * h) @ net.wh[way][:, 2 * n :])
                h = h + z * (m - h)
                out.append(h)
            states.append(out if way == 0 else out[::-1])
        s = [np.concatenate(p) for p in zip(*states, strict=True)]
        e = np.array([np.tanh(v @ net.wa) @ net.va for v in s])
        weight = np.exp(e - e.max())
        pooled = sum(w * v for w, v in zip(weight / weight.sum(), s, strict=True))
        best = max(best, float(pooled @ net.u + net.c[0]))
        if at + toxicity.WINDOW >= len(xs):
            return float(sigmoid(best))
        at += toxicity.STRIDE


def test_toxicity_against_plain_loops(spark):
    rows = toxic_docs(200)
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows], epochs=2)
    rng = random.Random(3)
    texts = [prose(rng, "en", n) + " scum " * (n % 2) for n in (1, 5, 47, 48, 49, 80, 81, 200)]
    assert np.allclose(model.scores(texts), [plain_score(model, t) for t in texts], atol=1e-4)


def plain_language(model, text):
    """Language of a text by dictionaries of n-grams and codewords, in plain loops."""
    padded = b"    " + text.lower().encode() + b"    " + b"    "
    counts = {}
    for i in range(len(padded) - 4):
        a, b, c, d = padded[i : i + 4]
        two = (a * 0x9E3779B1 + b * 0x85EBCA77) & 0xFFFFFFFF
        three = (two + c * 0xC2B2AE3D) & 0xFFFFFFFF
        four = (three + d * 0x27D4EB2F) & 0xFFFFFFFF
        for g, salt in ((two, 0x3C6EF372), (three, 0xDAA66D2B), (four, 0x78DDE6E4)):
            g ^= salt
            g = ((g ^ g >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            counts[g >> 20] = counts.get(g >> 20, 0) + 1
    norm = sum(counts.values()) ** 0.5
    losses = []
    for word, trust in zip(model.code, model.trust, strict=True):
        loss = 0.0
        for bit in range(len(word)):
            z = model.bias[bit] + sum(n**0.5 / norm * model.weights[f, bit] for f, n in counts.items())
            loss += np.logaddexp(0, -z * word[bit]) * trust[bit]
        losses.append(loss)
    return model.langs[int(np.argmin(losses))], 1 / sum(np.exp(min(losses) - x) for x in losses)


def test_language_query_against_plain_loops(spark, monkeypatch):
    from shelfmark.llm import queries

    models = []
    predict = langid.predict
    monkeypatch.setattr(langid, "predict", lambda docs, model, **k: models.append(model) or predict(docs, model, **k))
    rows = queries.queries()["op5_output_codes"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    some = [r for r in rows if r.lang_pred != "und" and len(texts[r.doc_id]) < 4_000]
    assert len(some) > 50
    for r in some[:60]:
        lang, score = plain_language(models[0], texts[r.doc_id])
        assert lang == r.lang_pred and abs(score - r.score) < 1e-4
    marks = spark.createDataFrame([(1, "²½Ⅷ 12 ____"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.lang_pred for r in langid.predict(marks, models[0]).collect()} == {"und"}
