import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, jaccard, textops, urlfilter, wrappers
from shelfmark.llm.components import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_shingles_match_plain_python():
    texts = ["", None, "a", "A b c", "É é  x\ty\nz a b a b a b", "q " * 700_000, " \t"]
    for i, tokens in textops.doc_shingles(texts, 4):
        assert len(tokens) == len(shingle_set(texts[i], 4))
    same = dict(textops.doc_shingles(["a b c d e", "x", "A  b\tC d e"], 4))
    assert np.array_equal(same[0], same[2])


def brute_components(rows, k, threshold):
    sets, par = {i: shingle_set(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in inverted[g] if j > i).items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((find(i), find(j)))
                par[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [out[at], f"n{rng.randrange(10**6)}"]])
    return out


@pytest.mark.parametrize("block_rows", [5, 2000])
def test_jaccard_components_against_brute_force(spark, block_rows):
    rng = random.Random(7)
    rows, passage = [], [f"p{i}" for i in range(25)]
    for base in range(8):  # groups of near copies whose similarities lie about the threshold
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 150]))]
        rows += [" ".join(edited(rng, words, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))) for _ in range(18)]
    rows += [" ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40))]) for _ in range(60)]
    rows += ["a", "a b", "A  B", "one two three", "", " "]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = jaccard.classify(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=block_rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 0.85)


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**63, rng.integers(5, 200)).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate((base[: int(len(base) * 0.97)], rng.integers(0, 2**63, 2).astype(np.uint64))))]
    sets.sort(key=len)
    bits, n = np.stack([jaccard.bitmap(s) for s in sets]), np.array([len(s) for s in sets])
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(np.intersect1d(sets[i], sets[j])) >= 0.85 * len(np.union1d(sets[i], sets[j]))}
    got = {p for x, y in jaccard.pairs_of(jaccard.Tree(bits, n, np.arange(60)), None, 0.85) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert want <= got and len(got) < 200
    a, b = (jaccard.Tree(bits[k::2], n[k::2], np.arange(30) + 30 * k) for k in (0, 1))
    cross = {(2 * i, 2 * j + 1) for x, y in jaccard.pairs_of(a, b, 0.85) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert {p for p in want if p[0] % 2 == 0 and p[1] % 2 == 1} <= cross


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (200, 200)]
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert out == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_deduplicate_messy(messy, none):
    out = jaccard.deduplicate(messy, 5, 0.8)
    assert out.columns == messy.columns
    rows = out.collect()
    ids = Counter(r.doc_id for r in rows)
    assert ids[100] == 1 and not ids[101] and not ids[102]  # the group's smallest id stays
    assert ids[110] == 2 and all(ids[i] == 1 for i in (103, 104, 105, 107, 108))
    assert sum(r.doc_id is None for r in rows) == 2  # one is a copy of 100
    assert jaccard.deduplicate(none).count() == 0
    one = jaccard.classify(messy).filter("doc_id IN (100, 101, 102, 103, 104)").collect()
    assert {r.doc_id: r.component_id for r in one} == {100: 100, 101: 100, 102: 100, 103: 103, 104: 104}


def contained(texts, items, k=5, threshold=0.8):
    out = set()
    plain = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    for d, t in texts:
        w = plain(t)
        for i, q in items:
            v = plain(q)
            if v:
                m = min(k, len(v))
                a, b = ({tuple(x[p : p + m]) for p in range(len(x) - m + 1)} for x in (v, w))
                if len(a & b) >= threshold * len(a) - 1e-9:
                    out.add((d, i, len(a), len(a & b)))
    return out


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_containment_against_brute_force(spark, most):
    rng = random.Random(4)
    items = [(i, " ".join(f"W{rng.randrange(500)}" for _ in range(rng.choice([3, 6, 20, 60])))) for i in range(40)] + [(90, None), (91, ""), (5, "same id other text of seven words"), (0, "w1, w2.")]
    texts = []
    for d in range(80):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 300))]
        if d % 2:
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(rng, items[d % 40][1].lower().split(), rng.choice([0, 0.03, 0.06]))
        texts.append((d, " ".join(words)))
    texts += [(200, None), (201, ""), (202, items[2][1]), (202, items[2][1])]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in decontaminate.scan(docs, bench, most_item_shingles=most).collect()}
    want = contained(texts, items)
    assert {x[:2] for x in found} == {x[:2] for x in want} and len(want) > 20
    kept = decontaminate.remove_contaminated(docs, bench, most_item_shingles=most).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, _ in texts if d not in {x[0] for x in want})


@pytest.mark.parametrize("most", [2_000_000, 1])
def test_containment_messy(spark, messy, none, most):
    bench = spark.createDataFrame([(1, "same row twice"), (2, None), (None, "one id and another text")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.scan(messy, bench, most_item_shingles=most).collect() if r.item_id)
    assert got == [(110, 1)]
    kept = decontaminate.remove_contaminated(messy, bench, most_item_shingles=most)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 3
    assert decontaminate.scan(none, bench, most_item_shingles=most).count() == 0
    assert decontaminate.scan(messy, bench.limit(0), most_item_shingles=most).count() == 0
    assert decontaminate.remove_contaminated(messy, bench.limit(0), most_item_shingles=most).count() == messy.count()


RULES = [urlfilter.Rule("block", "com", "/en/"), urlfilter.Rule("allow", "example.com", "/en/7"), urlfilter.Rule("allow", "net", "/de/"), urlfilter.Rule("block", "example.net", "/de/8")]


def page_rank(seeds, edges, damping, rounds=1000):
    """Settled ranks; ``edges`` are (src, dst): weight."""
    total, out = sum(seeds.values()), Counter()
    for (a, _), w in edges.items():
        out[a] += w
    rank = {}
    for _ in range(rounds):
        new = {h: (1 - damping) * s / total for h, s in seeds.items()}
        for (a, b), w in edges.items():
            new[b] = new.get(b, 0) + damping * rank.get(a, 0) * w / out[a]
        rank = new
    return rank


def domain_edges(hosts, weight=0.25):
    out = {}
    for h in hosts:
        while h.count(".") > 1:
            up = h.split(".", 1)[1]
            out[h, up] = out[up, h] = weight
            h = up
    return out


def test_url_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a> <a class=z href=//{h.upper()}?q>' for h in hosts)
    pages = [
        (1, "https://A.example.COM/en/7?x", ""), (2, "http://good.net/de/1", link("friend.org", "mid.org")), (3, "http://friend.org/", link("far.org", "good.net")),
        (4, "http://bad.com/en/1#t", ""), (5, "http://farm.org/a", link("bad.com")), (6, "http://mid.org", link("bad.com", "good.net")), (7, "http://alone.org?z", None), (8, None, link("bad.com")), (9, "no scheme", ""),
        (10, "http://far.org/y", ""), (11, "http://xcom/en/1", ""), (12, "http://q.example.net/de/88", ""), (13, "x://h.com:80/en/", ""), (4, "http://bad.com/en/1#t", ""),
    ]
    out = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in out.items()} == {
        1: ("a.example.com", "/en/7", "example.com/en/7"), 2: ("good.net", "/de/1", "net/de/"), 3: ("friend.org", "/", None), 4: ("bad.com", "/en/1", "com/en/"), 5: ("farm.org", "/a", None), 6: ("mid.org", "", None),
        7: ("alone.org", "", None), 8: ("", "", None), 9: ("", "", None), 10: ("far.org", "/y", None), 11: ("xcom", "/en/1", None), 12: ("q.example.net", "/de/88", "example.net/de/8"), 13: ("h.com:80", "/en/", None),
    }
    assert [out[i].verdict for i in (1, 2, 4, 12)] == ["allow", "allow", "block", "block"]
    linked = [("good.net", "friend.org"), ("good.net", "mid.org"), ("friend.org", "far.org"), ("friend.org", "good.net"), ("farm.org", "bad.com"), ("mid.org", "bad.com"), ("mid.org", "good.net")]
    edges = domain_edges(["a.example.com", "q.example.net"]) | {(a, b): 1.0 for a, b in linked}
    trust = page_rank({"a.example.com": 1, "good.net": 1}, edges, 0.85)
    distrust = page_rank({"bad.com": 2, "q.example.net": 1}, {(b, a): w for (a, b), w in edges.items()}, 0.85)
    for r in out.values():
        good, bad = trust.get(r.host, 0), distrust.get(r.host, 0)
        assert abs(r.trust - good) < 1e-6 and abs(r.distrust - bad) < 1e-6
        if r.rule is None:
            assert r.verdict == ("block" if bad > good else "allow")
    assert [out[i].verdict for i in (5, 7, 10)] == ["block", "allow", "allow"]
    none = spark.createDataFrame([], "page_id long, url string, html string, verdict int")
    assert urlfilter.judge(none, RULES).count() == 0


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body>{body}</body></html>"


def test_wrappers_extract_articles(spark):
    shell = '<nav><ul><li><a href="/a">Menu {i}<li><a>More</a></ul></nav><div class="ad">Buy {i}</div><article><h1>Title {i}</h1><p>One &amp; two\n {i}<p><b>Bold<br><p>T&eacute;xt &lt;b&gt;</p>{x}<div class="comments"><p>Nice</p></div></article><aside>side</aside><footer>&copy; {i}</footer>'
    pages = [(i, f"http://a.org/{i}", page(shell.format(i=i, x="<ul><li>p<li>q</ul>" if i % 2 else "<!-- gone --><form>f</form>"))) for i in range(6)]
    plain = '<div id="top">Same header</div><div class="c"><p>Body {i}</p><p>More {i}</p></div><div id="end">Same end</div>'
    pages += [(10 + i, f"http://b.org/{i}", page(plain.format(i=i))) for i in range(4)]
    pages += [(20, None, page("<article>Lone</article>")), (21, "http://a.org/x", None), (22, "http://a.org/y", ""), (23, "http://a.org/z", "<p>no article < here"), (24, "http://a.org/w", "<article><p>cut <b>short &am"), (0, "http://a.org/0", pages[0][2])]
    pages += [(30, "http://long.org/", page("<article>" + "<p>word</p>" * 20_000 + "</article>"))]
    rows = wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    out = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    assert out[0] == "Title 0\nOne & two 0\nBold\nTéxt <b>" and out[1] == "Title 1\nOne & two 1\nBold\nTéxt <b>\np\nq"
    assert out[12] == "Body 2\nMore 2"
    assert [out[i] for i in (20, 21, 22, 23)] == ["Lone", "", "", "no article < here"] and out[24].startswith("cut short")
    assert out[30] == "\n".join(["word"] * 20_000)
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string, extra int")).count() == 0


def test_union_free_alignment():
    e = wrappers.expression
    one = e("<ul><li>a</li><li>b</li></ul><p>x</p>")
    assert [(n[wrappers.LABEL], n[wrappers.REPEATED]) for n in one[wrappers.CHILDREN][0][wrappers.CHILDREN]] == [("li", True)]
    pair = e("<dl><dt>a<dd>b<dt>c<dd>d</dl>")[wrappers.CHILDREN][0][wrappers.CHILDREN]
    assert len(pair) == 1 and pair[0][wrappers.LABEL] == wrappers.GROUP and pair[0][wrappers.REPEATED]
    both = wrappers.merge(one, e("<p>x</p><hr>"))[wrappers.CHILDREN]
    assert [(n[wrappers.LABEL], n[wrappers.OPTIONAL], n[wrappers.TEXT]) for n in both] == [("ul", True, ""), ("p", False, "x"), ("hr", True, "")]
    assert wrappers.merge(e("<p>x"), e("<p>y"))[wrappers.CHILDREN][0][wrappers.TEXT] is None


def test_hosts_split_over_tasks_give_one_wrapper(spark):
    rows = [(i, f"http://a.org/{i}", page(f"<div class='c'><p>{i}</p></div><div>fixed</div>")) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8, F.col("page_id"))
    got = wrappers.infer(pages).collect()
    assert [(r.host, r.pages) for r in got] == [("a.org", 40)]


def test_jaccard_with_all_shingles_counted_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_SHARE", 1 << 40)
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(80)]
    rows = list(enumerate([" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02]))) for _ in range(30)] + ["a b", "", "a B"]))
    got = jaccard.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 0.85)


def test_large_groups_give_fewer_rows_than_they_hold(spark):
    """Three thousand near copies, and three thousand long texts that share a passage: neither becomes pairs."""
    rng = random.Random(10)
    base, passage = [f"w{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    near = [" ".join(base[:i % 110] + [f"x{i}"] + base[i % 110 + 1 :]) for i in range(3_000)]
    far = [" ".join(passage + [f"u{rng.randrange(10**7)}" for _ in range(240)]) for _ in range(3_000)]
    docs = spark.createDataFrame(list(enumerate(near + far)), "doc_id long, text string").repartition(8)
    profiles, links = jaccard.join(docs)
    n = links.count()
    assert 2_999 <= n < 10 * 3_000  # a forest for each of a few blocks; all pairs would be 4.5 million
    out = {r.doc_id: r.component_id for r in jaccard.classify(docs).collect()}
    assert all(out[i] == 0 for i in range(3_000)) and all(out[i] == i for i in range(3_000, 6_000))


def test_memory_of_a_batch_follows_a_piece():
    texts = [None, "", "w " * 1_500_000, *(f"word{i} " * 400 for i in range(5_000)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "text"])
    size = sum(len(t or "") for t in texts)
    assert [i for p in textops.pieces(batch, 1) for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(t or "") + 1 for t in p.column(1).to_pylist()) <= textops.PIECE_BYTES for p in textops.pieces(batch, 1))
    assert list(textops.pieces(batch.slice(0, 0), 1)) == []
    small = batch.slice(3)
    tracemalloc.start()
    got = sum(len(w) for p in textops.pieces(small, 1) for _, w in textops.doc_words(p.column(1).to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 5_000 * 400 and peak < 24 << 20 < size * 2
