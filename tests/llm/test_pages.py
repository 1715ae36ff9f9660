"""Page and vector operators."""

import base64
import hashlib
import io
import json
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.llm import ann, htmlextract, urlfilter, warc
from oriel.llm.htmltree import parse, walk

PAGES = [
    (1, "http://A.Example.net/en/x?q=1", "<p>one</p>"),
    (2, "https://x.example.com/de/", "<p>one</p>"),
    (3, None, None),
    (4, "no scheme", ""),
    (5, "https://casino-win.example.org/a", "é<b>\U0001f600</b>" * 2000),
    (6, "http://foo.org/fr/a/b#c", ""),
    (6, "http://foo.org/fr/a/b#c", ""),
    (7, "https://net/", "\r\n\r\nWARC/1.1\r\n"),
    (8, "http://a.spam-policy.example.com/?x://y", "z"),
    (None, "http://h.com/p", "<p>one</p>"),
]
SCHEMA = T.StructType().add("page_id", "long").add("url", "string").add("html", "string").add("host", "string").add("text", "string").add("digest", "string")


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(*p, "x", "y", "z") for p in PAGES], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# archives


def test_archives_come_back_as_they_were(spark, pages):
    got = warc.round_trip(spark, pages).collect()
    assert len(got) == len(PAGES)
    html = {p: (h or "").encode() for p, _, h in PAGES}
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[(h or "").encode()] = min(first.get((h or "").encode(), p), p)
    for r in got:
        body = html[r.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = r.page_id is not None and first[body] != r.page_id
        if r.page_id is not None:
            assert (r.record_type, r.refers_to) == (("revisit", first[body]) if revisit else ("response", None))
    assert warc.round_trip(spark, nothing(spark)).count() == 0


def test_small_payloads_are_all_responses(spark, pages):
    got = {r.page_id: r.record_type for r in warc.round_trip(spark, pages, least_bytes=1000).collect()}
    assert set(got.values()) == {"response"}


def test_members_are_read_in_any_chunks():
    made = [warc.page_record(i, "http://x/", bytes([65 + i]) * i * 50, 0 if i == 2 else None) for i in range(4)]
    data = b"".join(warc.member(r) for r in made)
    for chunk in (1, 7, 1 << 16):
        got = list(warc.records(io.BytesIO(data), chunk))
        assert [r.get("WARC-Type") for r in got] == ["response", "response", "revisit", "response"]
        assert got[3].payload == b"D" * 150


@pytest.mark.parametrize("spoil", ["cut", "digest", "length", "gzip"])
def test_broken_archives_are_refused(spoil):
    raw = zlib.decompress(warc.member(warc.page_record(1, "http://x/", b"body", None)), 31)
    if spoil == "digest":
        raw = raw.replace(b"body", b"bodY")
    if spoil == "length":
        raw = raw.replace(b"\r\n\r\nHTTP", b"\r\n\r\nxHTTP")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = z.compress(raw) + z.flush()
    data = data[:-9] if spoil == "cut" else b"plain" + data if spoil == "gzip" else data
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(data)))


# urls


def test_urls_are_judged(spark, pages):
    got = {(r.page_id, r.host): r for r in urlfilter.judge(pages).collect()}
    assert urlfilter.judge(pages).count() == len(PAGES)
    say = lambda p, h: (got[p, h].path, got[p, h].rule, got[p, h].verdict)
    assert say(1, "a.example.net") == ("/en/x", "example.net/en/", "allow")
    assert say(2, "x.example.com") == ("/de/", "example.com/de/", "block")
    assert say(3, "") == ("", None, "allow") and say(4, "") == ("", None, "allow")
    assert say(5, "casino-win.example.org") == ("/a", None, "block")
    assert say(6, "foo.org") == ("/fr/a/b", "org/fr/", "allow")
    assert say(7, "net") == ("/", "net/", "block")
    assert say(8, "a.spam-policy.example.com") == ("/", None, "allow")
    assert urlfilter.judge(nothing(spark)).count() == 0


def test_patterns_need_tokens(spark, pages):
    with pytest.raises(ValueError):
        urlfilter.judge(pages, pattern_rules=(urlfilter.PatternRule("block", "x.*", ()),))


def test_rules_come_from_files(spark, tmp_path):
    (tmp_path / "hosts.json").write_text("\n".join(f'{{"host": "h{i}.test", "path": "/", "verdict": "block"}}' for i in range(30_000)) + '\n{"host": "a.h7.test", "path": "/ok", "verdict": "allow"}\n')
    (tmp_path / "patterns.json").write_text('{"verdict": "block", "pattern": "[?]bad=", "tokens": ["bad"]}\n')
    urls = ["http://x.y.h29999.test/", "http://a.h7.test/ok/1", "http://b.a.h7.test/no", "http://h30000.test/?bad=1", "http://h30000.test/bad", "http://" + "x." * 3000 + "h1.test/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    hosts, patterns = urlfilter.read_host_rules(spark, str(tmp_path / "hosts.json")), urlfilter.read_pattern_rules(spark, str(tmp_path / "patterns.json"))
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, hosts, patterns).collect()}
    assert got == {0: ("h29999.test/", "block"), 1: ("a.h7.test/ok", "allow"), 2: ("h7.test/", "block"), 3: (None, "block"), 4: (None, "allow"), 5: ("h1.test/", "block")}


# html


@pytest.fixture(scope="module")
def model():
    return htmlextract.trained(htmlextract.Extractor())


def test_held_out_pages(model):
    right = total = 0
    for nodes, good in htmlextract.labelled(77, 120):
        kept = htmlextract.decode(nodes, model.logit(htmlextract.features(nodes)))
        for n, g in zip(nodes, good):
            if any(isinstance(t, str) and t.strip() for t in n.parts):
                total += 1
                right += (id(n) in kept) == bool(g)
    assert right / total > 0.99


def test_text_of_a_page(model):
    page = """<html><head><title>no</title><style>p{}</style><script>var a="</p>"</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>
    <div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p><b>First   line.<br><p>Second &eacute;&#33; line, which goes on for some words more.</article>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>I like it.</p></div></section><footer>&copy; nobody &middot; all rights.</footer></body></html>"""
    assert htmlextract.texts([page], model) == ["A & B\nFirst line.\nSecond é! line, which goes on for some words more."]
    assert htmlextract.texts(["", "<", "<!-- x", "<script>a"], model)[0] == ""


def test_decoding_never_keeps_a_child_of_what_it_drops(model):
    r = np.random.default_rng(0)
    for nodes, _ in htmlextract.labelled(5, 20):
        kept = htmlextract.decode(nodes, r.normal(0, 5, len(nodes)))
        assert all(n.parent is None or id(n.parent) in kept for n in nodes if id(n) in kept)


def test_extraction_keeps_every_row(spark, pages):
    got = htmlextract.extract(pages).collect()
    assert len(got) == len(PAGES) and all(r.n_chars == len(r.text) for r in got)
    assert htmlextract.extract(nothing(spark)).count() == 0


def test_deep_and_broken_markup():
    nodes = walk(parse("<div>" * 3000 + "x" + "</p></span></div>"))
    assert len(nodes) == 3001


# vectors


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, list string, id int")


def test_neighbours_and_ties(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(0, 1, (600, 8)), 2).astype(np.float32)
    x[100:200] = x[0]  # one vector a hundred times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (1000, [0.0] * 8), (1100, [float("nan")] * 8), (1200, [1.0, None] + [0.0] * 6), (1300, [1.0] * 7), (None, [1.0] * 8), (0, rows[0][1])]
    df = vectors(spark, rows + bad)
    got = ann.search(df, df.where("vec_id % 100 = 0"), ann.Spann(list_size=32)).collect()
    queries = [q for q in range(0, 600, 100)]
    assert {g.query_id for g in got} == set(queries)
    hits = 0
    for q in queries:
        own = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.rank for g in own] == list(range(1, 11))
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hits += len(set(want) & {g.vec_id for g in own})
        assert all(abs(g.score - d[g.vec_id]) < 1e-12 for g in own)
    assert hits / (10 * len(queries)) >= 0.9


def test_few_and_no_vectors(spark):
    two = vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.5])])
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 0.5)]
    none = vectors(spark, [])
    assert ann.search(none, none).count() == 0


@pytest.mark.parametrize(
    "make",
    [lambda n: "<a " * n, lambda n: '<a "' * (2 * n + 1) + ">x", lambda n: "<div>" * n, lambda n: "<table><td><p><td>" + "<x><div>" * n, lambda n: "<b>a" * n, lambda n: "<span class=a>a" * n, lambda n: "a<b>b</b>" * n,
     lambda n: "<script>" + "</script " * n, lambda n: "<style>" + "</style x=" * n + ">"],
)
def test_hostile_pages_take_time_in_proportion(make):
    def seconds(n):
        page = make(n)
        began = time.perf_counter()
        root = parse(page)
        htmlextract.blocks(root, {id(x) for x in walk(root)})
        return time.perf_counter() - began

    assert seconds(32_000) < 16 * max(seconds(8_000), 0.02)


def test_inline_adverts_go_and_marked_words_stay(model):
    story = "This is a long story, with commas and much sense in it, that goes on for quite a while."
    page = f'<body><article><h1>A story of some length</h1><p>{story} <span class="ad">BUY NOW</span> {story} <span class="term">Marked words</span> end it.</p><custom-ad><p>promo here</p></custom-ad><p>{story}</p></article><footer>nobody</footer></body>'
    assert htmlextract.texts([page], model) == [f"A story of some length\n{story} {story} Marked words end it.\n{story}"]


def test_clusters_are_pruned_and_short_queries_answered(spark):
    r = np.random.default_rng(3)
    middles = r.normal(0, 10, (40, 16))
    x = (middles[np.arange(4000) % 40] + r.normal(0, 1, (4000, 16))).astype(np.float32)
    rule = ann.Spann(list_size=50)
    index = ann.Centroids.fit(x.astype(np.float64), 80, rule)
    ratio, most = ann.measured_ratio(index, x.astype(np.float64), rule)
    assert most <= 16  # of 80 lists
    table = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = ann.search(table, table.where("vec_id % 100 = 0"), rule).collect()
    hits = 0
    for q in range(0, 4000, 100):
        d = ((x.astype(np.float64) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({g.vec_id for g in got if g.query_id == q} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 400
    # a list of fewer vectors than a query wants
    far = vectors(spark, [(i, [float(i % 2) * 1000, (i + 1) / 100]) for i in range(9)])
    few = ann.search(far, far, ann.Spann(list_size=2, k=7)).collect()
    assert {q: sum(g.query_id == q for g in few) for q in range(9)} == dict.fromkeys(range(9), 7)


@pytest.mark.parametrize("distinct", [1, 20, 50])
def test_few_distinct_vectors_among_thousands(spark, distinct):
    r = np.random.default_rng(distinct)
    kinds = r.normal(0, 1, (distinct, 8)).astype(np.float32)
    x = kinds[r.integers(0, distinct, 2500)]
    table = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = ann.search(table, table.where("vec_id % 100 = 0")).collect()
    for q in range(0, 2500, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        want = sorted((float(d[i]), i) for i in range(2500))[:10]
        assert [(g.score, g.vec_id) for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == want


def test_shards_are_bounded_and_long_lists_split(spark):
    dealt = ann.Shards.deal(np.array([10.0, 10, 950, 10, 40, 60]), 100, 2)
    assert dealt.parts.tolist() == [1, 1, 10, 1, 1, 1]
    held = np.zeros(20)
    for first, parts, n in zip(dealt.first, dealt.parts, (10, 10, 950, 10, 40, 60)):
        held[first : first + parts] += n / parts
    assert held.max() <= 101
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (700, 8)).astype(np.float32)[r.integers(0, 700, 3000)]  # copies of most vectors
    table = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = ann.search(table, table.where("vec_id % 100 = 0"), ann.Spann(list_size=100, recall=1.0, shard_bytes=4 * 8 * 40)).collect()
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        own = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.rank for g in own] == list(range(1, 11)) and all(g.score == d[g.vec_id] for g in own)
        hits += len({g.vec_id for g in own} & set([i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]))
    assert hits >= 0.95 * 300


def test_a_query_goes_to_a_shard_once(spark, monkeypatch):
    rows = []
    probe = ann._probe

    def counted(*args):
        run = probe(*args)
        table = pa.table({"q": np.arange(50), "v": pa.array(x[:50].tolist(), pa.list_(pa.float32()))})
        rows.extend(b.num_rows for b in run(iter(table.to_batches())))
        return run

    x = np.random.default_rng(4).normal(0, 1, (4000, 16)).astype(np.float32)
    monkeypatch.setattr(ann, "_probe", counted)
    table = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert ann.search(table, table.where("vec_id % 100 = 0"), ann.Spann(list_size=16, shards=4)).count() == 400
    assert sum(rows) <= 50 * 5


def test_queries_that_want_more_lists_than_the_beam_get_them():
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (3000, 24))
    rule = ann.Spann(list_size=8, beam=16)
    index = ann.Centroids.fit(x, 300, rule)
    far = np.sqrt(((x[:40, None] - index.points[None]) ** 2).sum(2))
    for ratio in (1.3, np.inf):
        for v, found in zip(far, index.lists(x[:40], rule.beam, ratio)):
            assert set(found.tolist()) == set(np.flatnonzero(v <= ratio * max(v.min(), index.radius)).tolist())


def test_archives_roll_over_and_bad_headers_are_told(spark, pages, tmp_path):
    written = warc.write_archives(pages.repartition(1), str(tmp_path), archive_bytes=400).collect()
    assert len(written) >= 3 and sum(r.n_records for r in written) == len(PAGES)
    back = warc.read_archives(spark.createDataFrame([(r.archive,) for r in written], "archive string")).collect()
    assert sorted((r.page_id or 0, r.payload_bytes) for r in back) == sorted((p or 0, len((h or "").encode())) for p, _, h in PAGES)
    with pytest.raises(warc.WarcError, match="UTF-8"):
        warc.parse(b"WARC/1.1\r\nWARC-Target-URI: \xff\r\n\r\n")


def test_one_payload_of_most_pages_is_not_shuffled(spark, monkeypatch):
    rows = [(i, f"http://a/{i}", "same" if i % 3 else f"own {i}", "x", "y", "z") for i in range(300)] + [(5, "http://b", "other", "x", "y", "z"), (5, "http://b", "same", "x", "y", "z")]
    src = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = {(i, len(h), None if h != "same" or i == 1 else 1) for i, _, h, *_ in rows}
    for most in (500_000, 3):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        got = warc.round_trip(spark, src).collect()
        assert len(got) == len(rows) and {(r.page_id, r.payload_bytes, r.refers_to) for r in got} == want


@pytest.mark.parametrize(("pattern", "tokens"), [
    (r"://([^/?#]*\.)?free-bets\.", ("free", "bets")), (r"://([^/?#]*\.)?free-bets?\.", ("free",)), (r"[?&/]doubleclick[/.=]", ("doubleclick",)), (r"casino", ()), (r"/a[b-d]c/", ()),
    (r"/affiliate/click\?id=[0-9]+", ("affiliate", "click", "id")), (r"/(x|y)/end/", ("end",)), (r"/(up/)?down/", ("down",)), (r"/([a-z]*)down/", ()), (r"^http://(www\.)+go\.", ("http", "go")), (r"_one_(two)_", ("one", "two")), (r"/a.b/", ()), (r"/x{2}y/", ()),
])
def test_tokens_are_those_that_every_match_holds(pattern, tokens):
    assert urlfilter.literal_tokens(pattern) == tokens


def test_the_rarest_token_fetches(spark):
    urls = [f"http://s{i}.test/news/item{i}?ref=x" for i in range(200)] + ["http://s.test/news/zebra?ref=x", "http://s.test/zebra/", "http://s.test/news/?ref=x", "http://s.test/zebra/news"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    tokens = pages.select("url", F.expr("regexp_extract_all(url, '[a-z0-9]+', 0)").alias("tokens"))
    rule = urlfilter.PatternRule("block", r"/news/zebra\?ref=x$")
    assert rule.literals == ("news", "zebra", "ref", "x") or rule.literals == ("news", "zebra", "ref")
    assert [r.token for r in urlfilter.rule_index(tokens, urlfilter.pattern_table(spark, (rule,))).collect()] == ["zebra"]
    common = urlfilter.rule_index(tokens.where("url like '%zebra%'"), urlfilter.pattern_table(spark, (rule,))).collect()
    assert [r.token for r in common] == ["ref"]  # where zebra is frequent, another token fetches
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, (), (rule,)).collect()}
    assert [i for i, v in got.items() if v == "block"] == [200]
    with pytest.raises(ValueError, match="not every match"):
        urlfilter.judge(pages, (), (urlfilter.PatternRule("block", r"/news/zebra", ("zebra",)),))


def test_thousands_of_pattern_rules(spark, tmp_path):
    rules = [urlfilter.PatternRule("block" if i % 5 else "allow", rf"/shop{i % 700}/item{i}[/?]") for i in range(4000)]
    (tmp_path / "rules.json").write_text("\n".join(json.dumps({"verdict": r.verdict, "pattern": r.pattern, "tokens": r.literals}) for r in rules))
    urls = [f"http://h/shop{i % 700}/item{i}/" for i in range(0, 5000, 7)] + [f"http://h/shop{i}/" for i in range(700)] + [None] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, (), urlfilter.read_pattern_rules(spark, str(tmp_path / "rules.json"))).collect()}
    assert got == {p: "block" if u and p < 715 and p * 7 < 4000 and p * 7 % 5 else "allow" for p, u in enumerate(urls)}
