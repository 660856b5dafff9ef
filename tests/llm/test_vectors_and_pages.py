import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import ann, boilerplate, pivots, urlfilter
from barloom.llm.queries import LISTED, RULES, op1_nearest_neighbours, op6_exact_top_k

DIR = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors(spark, n=300, seed=0, odd=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 12)).astype(np.float32)
    rows = [(k, v.tolist(), "x", "y") for k, v in enumerate(x)]
    if odd:
        rows += [(n + k, rows[5][1], "x", "y") for k in range(60)]  # many copies of one
        rows += [(1000, None, "x", "y"), (1001, [0.0] * 12, "x", "y"), (1002, [NAN] + [1.0] * 11, "x", "y"), (1003, [None] + [1.0] * 11, "x", "y"), (1004, [INF] * 12, "x", "y"), (None, [1.0] * 12, "x", "y"), (1005, [3.0], "x", "y"), (20, rows[20][1], "x", "y")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string, score string")


def brute(rows, every, k, score, zero):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not zero and not any(v):
            continue
        good.setdefault(i, list(v) + [0.0] * (12 - len(v)))
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids], np.float64)
    out = {}
    for i in ids[ids % every == 0]:
        s = score(x, np.array(good[i], np.float64))
        other = ids != i
        order = np.lexsort((ids[other], -s[other]))[:k]
        out[int(i)] = list(zip(ids[other][order].tolist(), s[other][order].tolist()))
    return out


def answers(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in w}) / len(w) for q, w in want.items()])


def test_neighbours_of_odd_vectors(spark):
    df = vectors(spark)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, 20, 20, lambda x, q: x @ q, zero=False)
    got = answers(ann.nearest(df))
    assert set(got) == set(want) and recall(got, want) > 0.97
    copies = [q for q in want if q >= 300 and q < 360]
    assert all([v for v, _ in got[q]] == [v for v, _ in want[q]] for q in copies)  # ties, to the smaller id
    for q, pairs in got.items():
        scores = dict(want[q])
        assert all(abs(scores[v] - s) < 1e-9 for v, s in pairs if v in scores) and [s for _, s in pairs] == sorted((s for _, s in pairs), reverse=True)
    assert ann.nearest(df.where("vec_id < 0")).count() == 0 and ann.nearest(df.where("vec_id = 20")).count() == 0
    assert answers(ann.nearest(df.where("vec_id in (20, 7)")))[20][0][0] == 7


def test_all_candidates_if_there_are_few(spark):
    """Opposite vectors and clusters, which no bucket and no edge of the graph joins."""
    rng = np.random.default_rng(4)
    two = spark.createDataFrame([(20, [1.0, 2.0]), (7, [-1.0, -2.0])], "vec_id long, embedding array<float>")
    assert answers(ann.nearest(two)) == {20: [(7, -5.0)]}
    x = np.concatenate([rng.normal(0, 0.01, (10, 8)) + 1, rng.normal(0, 0.01, (10, 8)) - 1]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = answers(ann.nearest(df))
    assert sorted(v for v, _ in got[0]) == list(range(1, 20))
    same = spark.createDataFrame([(k, [0.5, 0.5]) for k in range(0, 60)], "vec_id long, embedding array<float>")
    assert [v for v, _ in answers(ann.nearest(same))[20]] == [v for v in range(21) if v != 20][:20]


def test_many_neighbours_of_few_vectors(spark):
    """k over every fixed size: ties of equal vectors, and more than a beam."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 120, 0), rng.normal(size=(380, 8))])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = answers(ann.nearest(df, k=110, every=100))
    assert all(len(v) == 110 for v in got.values()) and [v for v, _ in got[0]] == list(range(1, 111))
    s = x.astype(float) @ x[400].astype(float)
    s[400] = -np.inf
    want = np.lexsort((np.arange(500), -s))[:110]
    assert len({v for v, _ in got[400]} & set(want.tolist())) >= 100


def test_recall_where_the_beam_is_small(spark):
    """12,000 vectors, a hub that very many are near to among them."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12_000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:4000] = x[0] + 0.7 * x[:4000]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, hits = answers(ann.nearest(df, every=200)), []
    for q in range(0, 12_000, 200):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits.append(len(set(np.lexsort((np.arange(len(x)), -s))[:20].tolist()) & {v for v, _ in got[q]}) / 20)
    assert np.mean(hits) >= 0.9


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    got, hits = answers(op1_nearest_neighbours(spark, DIR)), []
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & {v for v, _ in got[int(q)]}) / 20)
    assert np.mean(hits) >= 0.9


def test_rounds_move_no_rows(spark, monkeypatch):
    """What is written between the steps grows with nodes, and with queries by shard, not with rounds and neighbours."""
    rows, table = [], ann.common.work_table

    def counted(df, name):
        out = table(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ann.common, "work_table", counted)
    n = 2000
    x = np.random.default_rng(7).normal(size=(n, 8)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert ann.nearest(df).count() == n // 20 * 20
    assert sum(rows) <= 2 * n + n // 20 * (16 + 42 + 24)


def test_recall_of_many_shards(spark, monkeypatch):
    """Shards by their bytes, and lengths that differ."""
    monkeypatch.setattr(ann, "SHARD_BYTES", 4 * 17 * 50, raising=True)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[::3, 9:] = 0
    df = spark.createDataFrame([(k, v[:9].tolist() if k % 3 == 0 else v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, hits = answers(ann.nearest(df)), []
    for q in range(0, 3000, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits.append(len(set(np.lexsort((np.arange(len(x)), -s))[:20].tolist()) & {v for v, _ in got[q]}) / 20)
    assert np.mean(hits) >= 0.95


def test_lists():
    """An id once, with its mark, whichever copy comes first; scores and ids come back; how many a shard may hold."""
    score, ids = np.array([[0.5, -0.25, 0.5, 0.75, -1.0]], np.float32), np.array([[3, 1, 3, 2, 0]])
    keys = ann.packed(score, ids)
    keys[0, 2] |= 1
    out = ann.best(keys, 4)
    assert ann.id_of(out).tolist() == [[2, 3, 1, 0]] and (out & 1).tolist() == [[0, 1, 0, 0]]
    assert np.allclose(ann.score_of(out), [[0.75, 0.5, -0.25, -1.0]], atol=1e-5)
    assert ann.share(22, 1) == 22 and ann.share(22, 2) == 22 and 8 < ann.share(22, 16) < 16


def test_exact_top_k_of_odd_vectors(spark):
    df = vectors(spark, 260, 3)
    whole = lambda v: np.floor(1024 * v)
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 10, 10, lambda x, q: whole(x) @ whole(q), zero=True)
    assert dict(answers(pivots.top(df, every=10))) == {q: [(v, int(s)) for v, s in w] for q, w in want.items()}
    assert pivots.top(df.where("vec_id < 0")).count() == 0 and answers(pivots.top(df.where("vec_id in (100, 1)")))[100][0][0] == 1


@pytest.mark.parametrize("kind, most", [("even", 0.45), ("clusters", 0.1)])
def test_exact_top_k_over_blocks_leaves_most_rows(spark, monkeypatch, kind, most):
    """Through the operator, over several blocks of queries and chunks of rows, with the share of pairs that was evaluated."""
    monkeypatch.setattr(pivots, "BLOCK_BYTES", 64 << 10)
    monkeypatch.setattr(pivots, "TOGETHER", 16)
    monkeypatch.setattr(pivots, "CHUNK", 1500)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64)) if kind == "even" else np.repeat(rng.normal(size=(60, 64)), 100, 0) + rng.normal(0, 0.2, (6000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    counts = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    got = answers(pivots.top(df, every=25, counts=counts))
    whole, ids = np.floor(1024 * x.astype(float)).astype(np.int64), np.arange(6000)
    for q in range(0, 6000, 25):
        s = whole @ whole[q]
        s[q] = -(1 << 50)
        order = np.lexsort((ids, -s))[:10]
        assert got[q] == list(zip(order.tolist(), s[order].tolist()))
    assert counts[1].value == 6000 * 240 and 0 < counts[0].value / counts[1].value < most


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 20)) * 1024)
    for n in (0, 3, 19, 20, 60):
        span = pivots.span_of(pivots.spread_pivots(x[:100], n) if n else x[:0])
        place = pivots.places(x, span)
        assert (pivots.bounds(place[:50], place) >= x[:50] @ x.T).all()
    huge = np.full((2, 20), 1e200)
    assert (pivots.bounds(pivots.places(huge, span), pivots.places(huge, span)) == np.inf).all()
    assert pivots.best(np.array([1, 2, 3]), np.array([-(1 << 63), 5, (1 << 63) - 1]), 2)[0].tolist() == [3, 2]


def test_large_numbers():
    a = np.array([[2.0**40, 1.0]])
    assert pivots.products(a, a).tolist() == [[(1 << 63) - 1]] and pivots.products(a / 2**12, a / 2**12).tolist()[0][0] == 2**56


def test_query_of_top_k(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.floor(1024 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64)
    got = answers(op6_exact_top_k(spark, DIR))
    assert set(got) == set(ids[ids % 100 == 0].tolist())
    for q, pairs in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -(1 << 50)
        order = np.lexsort((ids, -s))[:10]
        assert pairs == list(zip(ids[order].tolist(), s[order].tolist()))


# --- URL filter

URLS = {
    "https://Blog.Example.ORG/en/12?q#f": ("blog.example.org", "/en/12", "example.org/en/1", "block"),
    "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
    "http://example.org": ("example.org", "", None, "allow"),
    "http://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
    "ftp://a.com/fr/x": ("a.com", "/fr/x", "com/fr/", "allow"),
    "http://a.com/de/x://y": ("a.com", "/de/x://y", "com/de/", "block"),
    "http://m.spam-farm.example.net/any?x": ("m.spam-farm.example.net", "/any", None, "block"),
    "http://spam-farm.example.net#x": ("spam-farm.example.net", "", None, "block"),
    "http://xspam-farm.example.net/": ("xspam-farm.example.net", "/", None, "allow"),
    "http://?q": ("", "", None, "allow"),
    "no scheme.org/en/1": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "http://www.cheap-pills.example.org/fr/1": ("www.cheap-pills.example.org", "/fr/1", "org/", "allow"),
}


def listed(spark, urls=LISTED):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_judgement(spark):
    rows = [(k, u, "x", "y") for k, u in enumerate([*URLS, None, next(iter(URLS))])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, RULES, listed(spark)).collect()}
    assert len(got) == len(rows) and got[len(rows) - 2] == ("", "", None, "allow")
    assert [got[k] for k in range(len(URLS))] == list(URLS.values())
    assert urlfilter.judge(df.limit(0), RULES, listed(spark)).count() == 0
    assert urlfilter.judge(df, [], listed(spark, [])).where("verdict = 'block'").count() == 0


def test_filter_misses_nothing_and_passes_little(spark):
    entries = spark.range(20_000).select(F.concat(F.lit("h"), "id", F.lit(".com/")).alias("u"))
    table, blocks = urlfilter.bloom(entries, "u", 20_000)
    assert urlfilter.possible(entries, "u", table, blocks).count() == 20_000
    other = spark.range(20_000).select(F.concat(F.lit("g"), "id", F.lit(".com/")).alias("u"))
    assert urlfilter.possible(other, "u", table, blocks).count() < 600


def test_pages_on_the_list(spark):
    df = spark.createDataFrame([(1, "http://a.net/x/y/"), (2, "http://a.net/x/z"), (3, "http://b.a.net/x/y?q")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df, [], listed(spark, ["https://A.net/x/y#f", None])).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


# --- main text

PAGE = '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li>m</li></ul></nav><!-- c --><div class="ad">buy</div>{main}<footer>&copy; f</footer></body></html>'
CASES = {
    "<article><h1>H &amp; h</h1><p><b>One<br><p>two</p>three</article>": "H & h One two three",
    "<main><p>x<i>y</i>  z</p><aside>s</aside><form>f</form><section class='comments'><article>c</article></section></main>": "xy z",
    "<div id=content><p>a&#39;b&nbsp;c</p><div class='sidebar-left'>s</div><div class='cookieNotice'>n</div></div>": "a'b c",
    "<article><p>main</p></article><article class='comment'>reader</article>": "main",
    "<article><header><h1>T</h1></header><p>a < b</p><div hidden>h</div><script>if (a<b) x()</script></article>": "T a < b",
    "<div role=navigation>n</div><table><tr><td>1<td>2</table><textarea>x": "1 2",
    "": "",
}


#: Names and tags that speak of boilerplate without being it.
WRAPPERS = {
    '<div class="content-sidebar-wrap"><main><article><p>kept</p></article></main></div>': "kept",
    '<article class="post comments-open"><p>kept</p></article>': "kept",
    '<form id="aspnet"><div><h1>T</h1><p>kept text of the whole page</p></div></form>': "T kept text of the whole page",
    "<article data-u=http://x/><p>kept</p></article>": "kept",
    '<article><div class="search-engine-history"><p>kept</p></div><div class="ad-slot">a</div><ul class="share-buttons"><li>s</ul><div class="left-sidebar-wrap">l</div></article>': "kept",
    '<div id="content"><p>kept words that are many</p></div><div class="user-comments"><p>c</p></div><div id=site-footer>f</div>': "kept words that are many",
}


def test_wrappers_stay():
    for body, want in WRAPPERS.items():
        assert boilerplate.text_of(boilerplate.parse(f"<html><body>{body}</body></html>"), frozenset()) == want, body


def test_templates_decide_what_names_do_not_tell(spark):
    """Text that changes where recurring subtrees aren't deleted: within articles, and on pages without any mark."""
    box = "<div><p>Get ten letters for the price of nine</p></div><ul><li>one offer</li><li>two offers</li></ul>"
    rows = [(k, f"http://a.com/{k}", f"<body><article><h1>Head {k}</h1><p>same passage</p><p>text {k} of some length and more</p>{box}<table><tr><td>own {k}</td></tr></table></article></body>") for k in range(12)]
    rows += [(100 + k, f"http://b.com/{k}", f"<body><div>Home About Contact</div><div><p>story {k} that is told at length here</p></div>{box}</body>") for k in range(12)]
    # four different pages make no template, five do; copies of one page count once
    rows += [(200 + k, f"http://c.com/{k}", f"<body><article><p>page {k} with words of its own</p>{box}</article></body>") for k in range(4)]
    rows += [(300 + k, f"http://d.com/{k}", f"<body><article><p>page {k} with words of its own</p>{box}</article></body>") for k in range(5)]
    rows += [(400 + k, f"http://e.com/{k}", f"<body><article><p>one page with words of its own</p>{box}</article></body>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in boilerplate.extract(df).collect()}
    assert got[3] == "Head 3 same passage text 3 of some length and more own 3"
    assert got[103] == "story 3 that is told at length here"
    offers = "Get ten letters for the price of nine one offer two offers"
    assert got[201] == f"page 1 with words of its own {offers}" and got[301] == "page 1 with words of its own" and got[404] == f"one page with words of its own {offers}"
    plain = {r.page_id: r.text for r in boilerplate.extract(df, least_pages=1000).collect()}
    assert sum(plain[k] != got[k] for k in got) == 29


def test_lists_of_many_hosts_meet_their_pages_by_shuffle(spark, monkeypatch):
    rows = [(100 * h + k, f"http://h{h}.com/{k}", f"<body><div>Home About {h}</div><div><p>story {k} that is told at length here</p></div></body>") for h in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, boilerplate.extract(df).collect()))
    monkeypatch.setattr(boilerplate.common, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, boilerplate.extract(df).collect())) == want and want[0][2] == "story 0 that is told at length here"


def test_main_text(spark):
    for main, want in CASES.items():
        assert boilerplate.text_of(boilerplate.parse(PAGE.format(main=main)), frozenset()) == want
    for html, want in (("plain", "plain"), ("<", "<"), ("<p>a<div>b", "a b"), ("<a href='x>y", "y"), ("<!-- open", ""), ("</p></div>z", "z")):
        assert boilerplate.text_of(boilerplate.parse(html), frozenset()) == want
    deep = "<div>" * 20_000 + "x"
    assert boilerplate.text_of(boilerplate.parse(deep), frozenset({"none"})) == "x"


def test_templates_go(spark):
    block = "<div><p>Follow our letters</p></div>"
    rows = [(k, f"http://a.com/{k}", f"<body><div><p>own {k} words that are longer than the rest of it all</p></div>{block}</body>", "x") for k in range(20)]
    rows += [(50 + k, f"http://b.com/{k}", f"<body><article><p>same passage</p><p>page {k}</p></article></body>", "x") for k in range(20)]
    rows += [(90, None, None, "x"), (91, "u", "", "x"), (92, "http://c.com/", f"<body>{block}</body>", "x"), (92, "http://c.com/", f"<body>{block}</body>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in boilerplate.extract(df).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert got[3] == ["own 3 words that are longer than the rest of it all"] and got[53] == ["same passage page 3"]
    assert got[90] == got[91] == [""] and got[92] == ["Follow our letters"] * 2
    assert boilerplate.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op2_url_filter", "op3_source_mixing", "op4_main_text", "op6_exact_top_k", "op8_substring_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb

    from barloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in cols]) for r in rel.fetchall())
