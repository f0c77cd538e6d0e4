from shelfmark.llm import urlfilter

RULES = [urlfilter.Rule("allow", "good.net", "/"), urlfilter.Rule("block", "bad.com", "/")]


def verdicts(spark, pages):
    rows = [(i, url, "".join(f'<a href="http://{h}/">x</a>' for h in to)) for i, (url, to) in enumerate(pages)]
    out = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()
    return {r.host: r.verdict for r in out}


def test_hosts_far_from_a_blocked_seed_are_reached(spark):
    chain = [(f"http://h{i}.org/", [f"h{i - 1}.org" if i else "bad.com"]) for i in range(26)]
    out = verdicts(spark, [("http://bad.com/", []), ("http://good.net/", []), *chain])
    assert {out[f"h{i}.org"] for i in range(26)} == {"block"}


def test_small_ranks_of_many_seeds_are_no_reason_to_stop(spark):
    """Each seed's rank is below the old absolute tolerance."""
    many = spark.range(200_000).selectExpr("concat('s', id, '.org') AS host", "1 AS seed")
    edges = spark.createDataFrame([(f"s{i}.org", f"s{i + 1}.org") for i in (0,)] + [("s1.org", "x1.org")] + [(f"x{i}.org", f"x{i + 1}.org") for i in range(1, 8)], "src string, dst string")
    reached = {r.host for r in urlfilter.propagate(many, edges).filter("host LIKE 'x%'").collect()}
    assert reached == {f"x{i}.org" for i in range(1, 9)}


def test_edges_of_pages(spark):
    html = """<link rel=canonical href="https://One.org/x"><img src='//two.org/i.png'><form action=http://u@three.org:81/go><meta http-equiv=refresh content="0; url=ftp://four.org">
      <a href="/out?to=https://five.org/a">x</a> <a href="/a//no.org">local</a> <p>http://text.org is no link</p>"""
    pages = spark.createDataFrame([("h.org", "http://h.org/?a=1&u=http://six.org/x&v=https%3A%2F%2Fseven.org%2Fy#z", html), ("h.org", None, None)], "host string, url string, html string")
    assert {r.dst for r in urlfilter.links(pages).collect()} == {"one.org", "two.org", "three.org:81", "four.org", "five.org", "six.org"} | {"seven.org"}
    hosts = spark.createDataFrame([("a.b.c.org",), ("c.org",), ("10.0.0.1",), ("x.org:80",), ("",), (None,)], "host string")
    up = {("a.b.c.org", "b.c.org"), ("b.c.org", "c.org")}
    assert {tuple(r) for r in urlfilter.domain_ties(hosts).collect()} == up | {(b, a) for a, b in up}


def test_pages_without_a_rule_get_scores_that_are_no_seeds(spark):
    from shelfmark.llm.queries import URL_RULES

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = urlfilter.judge(pages, URL_RULES).collect()
    by_host = {}
    for r in rows:
        by_host.setdefault(r.host, []).append(r)
    unseeded = [r for own in by_host.values() if all(x.rule is None for x in own) for r in own]
    assert unseeded and sum(r.trust + r.distrust > 0 for r in unseeded) > 0.9 * len(unseeded)
    assert {r.verdict for r in unseeded} == {"allow", "block"}
