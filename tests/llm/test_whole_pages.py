import random
from html.parser import HTMLParser

from shelfmark.llm import wrappers


def texts(spark, pages):
    rows = [(i, url, f"<html><body>{body}</body></html>") for i, (url, body) in enumerate(pages)]
    out = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    return {r.page_id: r.text for r in out}


def test_copies_of_a_page_lose_no_text(spark):
    one = "<div><p>The only paragraph of this page.</p></div>"
    parted = "<h1>Title</h1><p>Before the list.</p><ul><li>a<li>b</ul><p>After the list.</p>"
    stamped = "<nav>{i}</nav><h1>Title</h1><p>A first paragraph.</p><p>And a second one.</p><div class='c'><i>{i}</i></div>"
    pages = [(f"http://one.org/{i}", one) for i in range(5)] + [("http://parted.org/", parted)] * 4
    pages += [(f"http://stamped.org/{i}", stamped.format(i=i)) for i in range(4)]
    out = texts(spark, pages)
    assert {out[i] for i in range(5)} == {"The only paragraph of this page."}
    assert {out[i] for i in range(5, 9)} == {"Title\nBefore the list.\na\nb\nAfter the list."}
    assert [out[9 + i] for i in range(4)] == [f"Title\nA first paragraph.\nAnd a second one.\n{i}" for i in range(4)]


def test_texts_of_one_beginning_are_no_fixed_text(spark):
    start = "Agency report of the day. " * 10
    out = texts(spark, [(f"http://a.org/{i}", f"<div id='top'>Same</div><div id='body'>{start}Story {i}</div>") for i in range(4)])
    assert [out[i] for i in range(4)] == [f"{start}Story {i}" for i in range(4)]


def test_parts_of_label_words_are_no_reason_to_drop():
    for label in ("div.side-by-side", "div.has-sidebar", "div.no-comments", "article.widget", "main.search", "div.related@main", "div#article-header"):
        assert not wrappers._is_away(label, False), label
    for label in ("div.sidebar", "div#site-footer", "div.cookie-notice", "ul.x.main-nav", "div.ad", "div.comment-list", "nav"):
        assert wrappers._is_away(label, False), label


def test_deep_and_long_pages(spark):
    rng = random.Random(2)
    kinds = ["p", "h2", "pre", "blockquote"]
    long = ["".join(f"<{k}>{i} {j}</{k}>" for j, k in enumerate(rng.choices(kinds, k=20_000))) for i in range(2)]
    pages = [("http://deep.org/", "<div>" * 5000 + "at the bottom"), ("http://deep.org/2", "<font>" * 1200 + "unclosed"), *[("http://long.org/", f"<article>{x}</article>") for x in long]]
    out = texts(spark, pages)
    assert out[0] == "at the bottom" and out[1] == "unclosed"
    assert [out[2 + i] for i in range(2)] == ["\n".join(f"{i} {j}" for j in range(20_000)) for i in range(2)]


def test_words_of_layout_around_and_in_an_article(spark):
    out = texts(spark, [
        ("http://a.org/", "<div class='layout has-sidebar'><article><div class='article-header'><h1>Title</h1></div><p>Body</p></article><div class='sidebar'>Side</div></div>"),
        ("http://b.org/", "<main><p>Only main.</p><ol class='comments'><li>Reader</ol></main>"),
        ("http://c.org/", "<div>Notice</div><article>Short</article>"),
    ])
    assert out == {0: "Title\nBody", 1: "Only main.", 2: "Short"}


def test_longest_common_subsequence_against_naive():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        for bits in (1, 40, 1 << 20):
            got = wrappers.common(a, b, bits)
            assert len(got) == table[0][0] and all(a[i] == b[j] for i, j in got)
            assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:], strict=False))


class Naive(HTMLParser):
    """Text below ``article`` or, without one, ``body``; what isn't the article goes by tag and by the class "ad"."""

    def __init__(self, root):
        super().__init__()
        self.root, self.stack, self.blocks, self.now = root, [], [], []

    def flush(self):
        self.blocks.append(" ".join("".join(self.now).split()))
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
        elif tag not in ("b", "i", "a", "em", "span"):
            self.flush()
        if tag not in ("br", "meta", "link", "hr", "img", "p", "b"):
            self.stack.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "span"):
            self.flush()
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        gone = ("head", "nav", "footer", "script", "style", "aside", "form", "title")
        if any(t == self.root for t, _ in self.stack) and not any(t in gone or c in ("ad", "comments") for t, c in self.stack):
            self.now.append(data)


def naive(page):
    for root in ("article", "body"):
        parser = Naive(root)
        parser.feed(page)
        parser.close()
        parser.flush()
        if text := "\n".join(b for b in parser.blocks if b):
            return text
    return ""


def test_query_against_a_naive_extractor(spark):
    from shelfmark.llm import queries

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    out = queries.queries()["op9_page_wrappers"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(pages)
    wrong = [r.page_id for r in out if r.text != naive(pages[r.page_id]) or r.n_chars != len(r.text)]
    assert not wrong, (wrong[:5], naive(pages[wrong[0]])[:300], next(r.text for r in out if r.page_id == wrong[0])[:300])


def body_of(i, about="Background"):
    return f"<h1>Title {i}</h1><p>First words of story {i}, which go on for a while.</p><h2>{about}</h2><p>Second part of story {i}, long enough too.</p>"


def test_the_same_words_on_two_and_three_pages(spark):
    """What all pages of a host share stays in their articles, however many pages there are."""
    for n in (1, 2, 3, 7):
        out = texts(spark, [(f"http://h{n}.org/{i}", body_of(i)) for i in range(n)])
        want = lambda i: f"Title {i}\nFirst words of story {i}, which go on for a while.\nBackground\nSecond part of story {i}, long enough too."
        assert out == {i: want(i) for i in range(n)}


def test_headers_notices_comments_and_adverts(spark):
    story = "<p>The story itself, which is long enough to be found.</p>"
    out = texts(spark, [
        ("http://a.org/", f"<article><div class='header'><h1>Title</h1></div>{story}</article>"),
        ("http://b.org/", f"<div class='header'>Site</div><div class='text'><div class='header'>Title</div>{story}{story}</div>"),
        ("http://c.org/", "<div class='alert'>The only text.</div>"),
        ("http://d.org/", f"<article>{story}<div class='user-comments'><p>Reader</p></div><ins class='adsbygoogle'>Buy</ins><div id='comment-12-body'>me too</div></article>"),
        ("http://e.org/", f"<article>{story}<div class='reader_comments'>x</div><div class='ad-slot'>y</div><div class='google'>kept</div><div class='commentary'>kept too</div></article>"),
        ("http://f.org/", "<nav>Home</nav><footer>End</footer>"),
        ("http://g.org/", "<nav>Home</nav><div id='cookie-notice'>Words</div><form>Box</form>"),
    ])
    one = "The story itself, which is long enough to be found."
    assert out == {0: f"Title\n{one}", 1: f"Title\n{one}\n{one}", 2: "The only text.", 3: one, 4: f"{one}\nkept\nkept too", 5: "", 6: "Words"}


def test_pages_without_article_tags_against_a_naive_extractor(spark):
    """The wrapper alone finds the article: ``article`` and ``main`` are turned into ``div``."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    bare = [(r.page_id, r.url, re.sub(r"(?i)<(/?)(?:article|main)\b", r"<\1div", r.html) if r.html else r.html) for r in rows]
    out = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(bare, "page_id long, url string, html string").repartition(4)).collect()}
    wrong = [r.page_id for r in rows if out[r.page_id] != naive(r.html)]
    print(len(wrong), "of", len(rows))
    for i in wrong[:3]:
        html = next(r.html for r in rows if r.page_id == i)
        print(repr(naive(html)[:200]), repr(out[i][:200]), len(naive(html)), len(out[i]))
    assert len(wrong) <= 0.02 * len(rows)


def test_clashing_names(spark):
    rows = [(1, "http://a.org/", "<article><p>Text</p></article>", "host", "wrapper", 3), (None, None, None, None, None, None), (2, "http://a.org/2", "", "x", "y", 1), (2, "http://a.org/2", "", "x", "y", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string, n_chars int")
    out = sorted(((r.page_id or 0, r.text, r.n_chars) for r in wrappers.main_text(table).collect()))
    assert out == [(0, "", 0), (1, "Text", 4), (2, "", 0), (2, "", 0)]
