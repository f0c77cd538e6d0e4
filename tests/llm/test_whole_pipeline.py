"""The whole pipeline against plain Python, and on empty tables."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
from shelfmark.llm import langid, mixing, queries

DIR = "/root/testdata/sf0.001"


def kept_languages(spark, docs):
    """Ids whose language is known: the predictions of the model itself, which the tests of models hold against loops."""
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(docs), ambiguous_margin=corpus_pipeline.AMBIGUOUS_MARGIN)
    return {r.doc_id for r in out.collect() if r.lang_pred != "und" and not r.ambiguous}


def one_of_each_group(rows):
    def shingles(text):
        words = re.findall(r"[^ \t-\r]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in rows.items()}
    least = {i: i for i in rows}
    linked = [(a, b) for a in rows for b in rows if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in rows:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
        if not changed:
            break
    return {i: t for i, t in rows.items() if least[i] == i}


def without_items(rows, items):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
    cut = lambda w, n: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}
    wanted = [(cut(w, min(5, len(w))), min(5, len(w))) for t in items if (w := words(t))]

    def holds(text):
        own = words(text)
        return any(len(s & cut(own, n)) >= max(1, math.ceil(0.8 * len(s) - 1e-9)) for s, n in wanted if len(own) >= n)

    return {i: t for i, t in rows.items() if not holds(t)}


def copies(rows, source):
    counts = Counter(source[i] for i in rows)
    weight = {s: queries.MIX_WEIGHTS.get(s, 1.0) for s in counts}
    out = Counter()
    for i in rows:
        rate = len(rows) * (weight[source[i]] / sum(weight.values())) / counts[source[i]]
        u = (int(hashlib.md5(f"mix:{i}#1".encode()).hexdigest()[: mixing.HEX], 16) + 0.5) / 2**mixing.BITS
        k, p = 0, math.exp(-rate)
        total = p
        while total < u:
            k += 1
            p *= rate / k
            total += p
        out[i] = k
    return +out


def test_against_plain_python(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows, source = {}, {}
    known = kept_languages(spark, docs)
    for r in docs.collect():
        source[r.doc_id] = r.source
        if r.doc_id in known:
            rows[r.doc_id] = r.text
    n0 = len(rows)
    rows = one_of_each_group(rows)
    n1 = len(rows)
    rows = without_items(rows, [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()])
    want = copies(rows, source)
    assert docs.count() >= n0 > n1 > len(rows) > 0
    got = corpus_pipeline.run(spark, DIR).collect()
    assert Counter(r.doc_id for r in got) == want
    by_shard = {s: [r for r in got if r.shard == s] for s in range(queries.SHARDS)}
    sizes = [len(v) for v in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by_shard.values())
    share = Counter(r.source for r in got)
    for v in by_shard.values():
        own = Counter(r.source for r in v)
        assert all(abs(own[s] - share[s] / queries.SHARDS) <= 2 for s in share)


def test_on_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and {"doc_id", "shard", "slot"} <= set(out.columns)
