"""Operator 12: statistics, rules, weights and the compiled column."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import langid, queries, rules

DIR = "/root/testdata/sf0.01"


def plain(text):
    """The statistics in plain Python, where they are simple to say."""
    words = [w for w in __import__("re").split("[ \t-\r]+", text or "") if w]
    solid = sum(map(len, words))
    letters = sum(c.isalpha() for w in words for c in w)
    lines = [x for x in __import__("re").split("[\n\r]+", text or "") if x]
    share = lambda a, b: a / b if b > 0 else 0.0
    return {
        "log_words": np.log1p(len(words)), "word_length": share(solid, len(words)), "longest_word": max(map(len, words), default=0), "letter_share": share(letters, solid),
        "capital_share": share(sum(c.isupper() for w in words for c in w), letters), "digit_share": share(sum(c in "0123456789" for c in text or ""), solid),
        "sign_share": share(sum(c in r"#$%&*+<=>@[\]^_`{|}~" for c in text or ""), solid), "call_share": share((text or "").count("!"), solid),
        "distinct_share": share(len(set(words)), len(words)), "short_share": share(sum(len(w) <= 3 for w in words), len(words)),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)), "repeated_line_chars": share(sum(map(len, lines)) - sum(map(len, set(lines))), sum(map(len, lines))),
        "sentence_words": share(len(words), sum(c in ".!?…" for c in text or "")), "line_words": share(len(words), len(lines)), "space_share": share(len(text or "") - solid, len(text or "")),
        "sign_run_share": share(sum(len(m) for m in __import__("re").findall(r"[!-/:-@\[-`{-~]{2,}", text or "")), solid),
    }


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t", "Ärger $$$ und ÑANDÚ!! a_b\nzwei\nzwei\r\nzwei 12", "x" * 100_000, "###", "één, twee… drie?\x0b\x0cEND", "a b " * 50_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows, stats = rules.statistics(docs)
    for r in rows.select("text", *[c.alias(n) for n, c in stats.items()]).collect():
        for name, want in plain(r.text).items():
            assert r[name] == pytest.approx(want), (name, (r.text or "")[:40])


def test_columns_compute_what_the_model_computes(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    model = rules.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows, stats = rules.statistics(docs)
    got = rows.select(*[c.alias(n) for n, c in stats.items()], model.column(stats).alias("score_")).collect()
    x = np.array([[r[n] for n in stats] for r in got])
    assert np.allclose([r["score_"] for r in got], model.scores(x), atol=1e-12)
    assert 0 < len(model.rules) < 100 and all(str(rule) for rule, _ in model.rules)
    plan = rules.score(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_held_out_quality(spark):
    out = queries.op12(spark, DIR)
    assert out.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
    held = out.filter("held_out").join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)
    good, bad = np.array([r.score for r in held if r.quality == 1]), np.array([r.score for r in held if r.quality == 0])
    assert (good[:, None] > bad[None]).mean() > 0.97 and (good >= 0.5).mean() > 0.97 and (bad < 0.5).mean() > 0.85


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    held_out = langid.fold(F.col("doc_id"), 3) == 1
    turned = labels.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rules.fit(docs, labels.filter(~held_out)) == rules.fit(docs, turned.filter(~held_out))


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(3)
    r = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 2 * r[:, 1] + 0.2)))).astype(float)
    w, b = rules.lasso(r, y, 0.02, (np.zeros(12), 0.0), 5_000)
    g = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / 400
    assert np.abs(g[w != 0] + 0.02 * np.sign(w[w != 0])).max() < 1e-4 and np.abs(g[w == 0]).max() <= 0.02 + 1e-4
    assert w[0] > 0 > w[1] and (w == 0).sum() >= 5


def test_paths_are_conjunctions_that_hold_together():
    rng = np.random.default_rng(4)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype(float)
    found = rules.paths(x, y, ["a", "b", "c"])
    assert any({(n, up) for n, up, _ in rule.bounds} >= {("a", True), ("b", False)} for rule in found)
    seen = {rule.holds(x, ["a", "b", "c"]).tobytes() for rule in found}
    assert len(seen) == len(found) and all(len(rule.bounds) <= rules.DEPTH for rule in found)


def test_messy_rows_and_clashing_names(spark, messy, none, clashing):
    from tests.llm.conftest import kept_whole

    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(40)] + [(None, 1, 0, "x"), (3, None, 0, "x"), (5, 1, 0, "x"), (5, 0, 0, "x")], "doc_id long, quality int, toxic int, score string")
    model = rules.fit(messy, labels)
    out = rules.score(messy, model)
    assert out.count() == messy.count() and all(r.score is not None and 0 <= r.score <= 1 for r in out.collect())
    assert out.columns.count("score") == 1
    assert kept_whole(rules.score(clashing, model).collect())
    assert rules.score(none, model).collect() == []
    empty = labels.limit(0)
    assert {r.score for r in rules.score(messy, rules.fit(messy, empty)).collect()} == {0.0}
    assert {r.score for r in rules.score(messy, rules.fit(messy, labels.filter("quality = 1"))).collect()} == {1.0}
    assert 0 < next(r.score for r in rules.score(messy, rules.fit(none, labels)).limit(1).collect()) < 1
