"""Formulas, texts and pages on small cases."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import scores, urls, vectors
from lodestar.functions import text as X
from lodestar.operators import ingest, pages, reads, texts
from lodestar.sources import shared


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_recency(spark):
    assert one(spark, scores.recency_decay(F.lit(48.0))) == 0.5
    assert one(spark, scores.recency_decay(F.lit(-1.0))) == 0.0
    assert [one(spark, scores.recency_decay(F.lit(x), 0)) for x in (0.0, 1.0)] == [1.0, 0.0]


def test_trust(spark):
    full = scores.score_rubric(F.lit(True), F.lit(True), F.lit(True), F.lit("balanced"), F.lit("low"))
    assert one(spark, full) == pytest.approx(1.0)
    assert one(spark, scores.score_rubric(F.lit(None).cast("boolean"), F.lit(False), F.lit(None).cast("boolean"), F.lit("odd"), F.lit(None).cast("string"))) == 0.0
    assert [one(spark, scores.source_prior(F.lit(d))) for d in ("arxiv.org", "x.org")] == [1.0, 0.5]
    assert one(spark, scores.source_prior(F.lit("x.org"), {"x.org": "low", "y.org": "odd"})) == 0.2
    assert [one(spark, scores.trending_score(F.lit(c))) for c in (None, 1, 3)] == [0.0, 0.5, 0.75]
    assert [one(spark, scores.safe_percent(F.lit(a), F.lit(b))) for a, b in ((1, 8), (3, 8), (1, 0))] == [12, 38, 0]


@pytest.mark.parametrize(("url", "netloc", "domain", "host", "label"), [
    ("https://www.Ex.com:80/a", "www.Ex.com:80", "ex.com:80", "www.ex.com", "RSS"),
    ("http://me@gist.github.com/x", "me@gist.github.com", "me@gist.github.com", "gist.github.com", "GitHub"),
    ("https://export.arxiv.org?x", "export.arxiv.org", "export.arxiv.org", "export.arxiv.org", "arXiv"),
    ("nothing", "", "", "", "RSS"),
])
def test_urls(spark, url, netloc, domain, host, label):
    u = F.lit(url)
    got = spark.range(1).select(urls.netloc(u), urls.domain(u), urls.host(u), urls.source_label(u)).first()
    assert tuple(got) == (netloc, domain, host, label)


def test_url_rules(spark):
    assert [one(spark, urls.url_status(F.lit(u))) for u in (None, " ", "ftp://a", "http://", "https://a.b/c")] == ["empty", "empty", "bad_scheme", "no_host", "ok"]
    assert one(spark, urls.arxiv_canonical(F.lit("http://arxiv.org/abs/2401.00001v3"))) == "https://arxiv.org/abs/2401.00001"
    assert one(spark, urls.github_slug(F.lit("https://github.com/a/b/tree?x"))) == "a/b"
    assert one(spark, urls.is_favicon(F.lit("https://a/favicon.ico?v=1")))


def test_preflight(spark):
    texts_ = ["We're hiring engineers", "a cover letter", "x" * 2001 + " apply now", "", None, "Free trialists"]
    assert [one(spark, X.preflight_reject(F.lit(t))) for t in texts_] == [True, True, False, False, False, False]


@pytest.mark.parametrize(("raw", "want"), [("<b>A</b> &amp; B", "A & B"), ("Vec<T>  x", "Vec<T> x"), ("&lt;i&gt;x", "x"), ("a\n b", "a b")])
def test_title(raw, want):
    assert X.title_text(raw) == want == X.title_text(want)


def test_page():
    page = '<html><head><title>T &amp; U</title><meta property="og:image" content="https://a/i.png"><meta property="article:published_time" content="2024-01-02"></head><body><nav>menu</nav><article><h1>H</h1><p>Body <b>text</b>.</p><script>x()</script></article><p>after</p></body></html>'
    assert X.page_fields(page) == ("T & U", "H\nBody text.", 1704153600, "https://a/i.png")
    assert X.page_fields("<p>x<img src='https://a/s.png' width=10><img src='https://a/l.png'>")[3] == "https://a/l.png"
    assert X.page_fields("<p>x", "https://a.b/c")[3] == "https://a.b/favicon.ico"
    assert X.page_fields(None) == (None,) * 4


def test_page_cut_references():
    """A reference without its semicolon is text, in titles, bodies and attributes."""
    page = "<title>A &amp; B &amp</title><article><h1>A &amp; B &amp</h1><p>R&D &ampx; &quot;q&quot; &lt &#65; &#65</article><meta property='og:image' content='https://a/i?x=1&lt=2&amp;y=3'>"
    assert X.page_fields(page) == ("A & B &amp", 'A & B &amp\nR&D &ampx; "q" &lt A &#65', None, "https://a/i?x=1&lt=2&y=3")
    assert X.title_text("<b>A</b> &amp; B &lt") == "A & B &lt"


@pytest.mark.parametrize(("name", "want"), [("AT&T", "at t"), ("DALL·E", "dall e"), ("Node.js", "node js"), ("U.S.", "us"), (".NET", ".net"), ("Corp.", "corp"), ("GPT 5.2", "gpt 5.2"), ("C++", "c++"), ("Ｆｕｌｌ", "full"), ("Acme,Inc.", "acme inc"), ("Foo…Bar", "foo bar")])
def test_canonical(name, want):
    assert X.canonical(name) == want == X.canonical(want)


@given(st.text(max_size=40))
def test_canonical_twice(name):
    once = X.canonical(name)
    assert X.canonical(once) == once


def test_simhash():
    body = "The release adds a faster tokenizer and a smaller index. It was tested on three machines over a week. " * 6
    sentences = body.split(". ")
    far = "Completely different words about gardens, rivers and the weather of the northern islands in winter. " * 6
    d = lambda a, b: ((X.simhash(a) ^ X.simhash(b)) & (1 << 64) - 1).bit_count()
    assert d(body, "New title. " + body) <= 6 and d(body, ". ".join(sentences[3:] + sentences[:3])) <= 3 and d(body, far) > 10
    assert X.simhash("") == X.simhash(None) == 0
    assert X.simhash("Ｆull width") == X.simhash("Full  width!")
    assert X.simhash("we use C++ here") != X.simhash("we use C# here")


def test_cursor():
    for sort, key in (("latest", (5, 7)), ("recommended", (0.5, 5, 7)), ("recommended", (None, 5, 7))):
        assert pages.decode_cursor(pages.encode_cursor(sort, *key), sort) == (sort, *key)
    with pytest.raises(ValueError):
        pages.decode_cursor(pages.encode_cursor("latest", 5, 7), "recommended")
    with pytest.raises(ValueError):
        pages.decode_cursor("rubbish", "latest")


@given(st.lists(st.sampled_from("abcd"), max_size=24))
def test_spread(domains):
    order = pages.spread(domains)
    assert sorted(order) == list(range(len(domains)))
    out = [domains[i] for i in order]
    if domains and max(map(domains.count, domains)) <= (len(domains) + 1) // 2:
        assert all(a != b for a, b in zip(out, out[1:]))


def test_bands_and_hero():
    assert pages.spread_bands(list("aab"), [True, True, False]) == [0, 1, 2]
    assert pages.pin_hero([1, 2, 3, 4], list("aabb"), [True] * 4, 3)[:2] == [3, 1]


def test_walk_all_pages(spark, sf):
    seen, cursor = [], None
    while True:
        page = reads.feed(spark, sf, cursor=cursor, limit=60).orderBy(F.col("feed_score").desc_nulls_last(), F.desc("eff_s"), F.desc("id")).collect()
        seen += [r.id for r in page[:60]]
        if len(page) <= 60:
            break
        cursor = ("recommended", page[59].feed_score, page[59].eff_s, page[59].id)
    assert len(seen) == len(set(seen)) == 200
    with pytest.raises(ValueError):
        reads.feed(spark, sf, sort="odd")
    with pytest.raises(ValueError):
        reads.feed(spark, sf, cursor=("latest", 1, 2))


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=64)
    close = base + 0.02 * rng.normal(size=64)
    other = rng.normal(size=64)
    other -= base * (other @ base) / (base @ base)
    df = spark.createDataFrame([(1, base.tolist()), (2, close.tolist()), (3, other.tolist()), (4, [0.0] * 64)], "id long, vector array<double>")
    assert [(r.a, r.b) for r in vectors.similar_pairs(df, df, 0.85, same=True).collect()] == [(1, 2)]
    got = df.crossJoin(df.where("id = 1").select(F.col("vector").alias("q"))).select("id", vectors.cosine(F.col("vector"), F.col("q")).alias("c")).collect()
    assert {r.id: round(r.c, 6) for r in got}[4] == 0 and math.isclose({r.id: r.c for r in got}[1], 1)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u @ u.T
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if c[i, j] > 0.5}
    got = [(r.a, r.b) for r in vectors.similar_pairs(df, df, 0.5, same=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_digest(spark):
    f = lambda d, s: one(spark, ingest.digest_accepted(F.lit(d), F.lit(s)))
    assert f("x " * 100, "y") and not f("x " * 10, "y") and not f("A  b" * 60, "a b" * 60)


def test_log(spark):
    df = spark.createDataFrame([(1, "run ok"), (2, "run failed"), (3, "run ok"), (4, "other")], "line int, value string")
    assert tuple(texts.log_summary(df, "ok$", "failed$").first()) == (3, 2, True)
    assert {r.name for r in texts.newest(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), 2).collect()} == {"a"}


def test_truncate(spark):
    df = spark.createDataFrame([("aé", 2), ("aé", 3), (None, 1)], "t string, n int")
    assert [r.x for r in df.select(X.truncate_utf8("t", "n").alias("x")).collect()] == ["a", "aé", None]


def test_simhash_of_many():
    """Hashes of a batch against one gram at a time, with short, empty and odd texts, and more letters than fit into a number."""
    import hashlib

    import numpy as np

    def slow(text):
        folded = X.simhash_text(text or "")
        grams = [folded[i : i + 4] for i in range(max(1, len(folded) - 3))] if folded else []
        hashes = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams]
        n = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        return n - (1 << 64) if n >> 63 else n

    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc déf 日本😀.+#_"), int(n))) for n in rng.integers(0, 200, 150)]
    texts += [None, "", "a", "abcd", "abcde", " " * 9, "x y " * 5000, "".join(map(chr, [c for c in range(0x4E00, 0x4E00 + 80_000) if not 0xD800 <= c < 0xE000]))]
    assert X.simhashes(texts).tolist() == [slow(t) for t in texts]


def test_simhash_codes():
    """Rules over all characters at once against simhash_text, for every neighbourhood of odd characters."""
    import itertools

    texts = ["".join(t) for n in range(5) for t in itertools.product("a1.+_\u0301 ", repeat=n)] + ["# 日本++.x İß ² ٣.é", "..\n!! ?", None]
    codes, lengths = X.simhash_codes(texts)
    joined, at, got = codes.tobytes().decode("utf-32-le"), 0, []
    for n in lengths:
        got.append(joined[at : at + n])
        at += n
    assert got == [X.simhash_text(t or "") for t in texts]


def test_simhash_known_grams():
    """A gram that an earlier batch had isn't hashed again."""
    asked, known = [], {}
    digest = lambda g: (asked.append(g), X.blake2b_8(g))[1]
    first = X.simhashes(["some words here", "some words"], digest=digest, known=known)
    assert sorted(asked) == sorted(set(asked))
    n = len(asked)
    assert X.simhashes(["some words"], digest=digest, known=known)[0] == first[1] and len(asked) == n


@pytest.mark.parametrize("n", [10, 50_000, 3_000_000, 10**9])
def test_agreeing_masks(n):
    """Some mask covers no place of any three; masks leave as few random pairs as rows, and are few."""
    import itertools

    from lodestar.operators.texts import agreeing_masks

    masks = agreeing_masks(n, 3)
    for places in itertools.combinations(range(0, 64), 3):
        bits = sum(1 << p for p in places)
        if not any(m & bits == 0 for m in masks):
            raise AssertionError(places)
    assert len(masks) <= 20 and all(n / 2 ** (m % (1 << 64)).bit_count() < 1 for m in masks)


def test_near_duplicate_pairs(spark, sf):
    """Pairs by bands against all pairs of hashes."""
    from lodestar.operators import texts

    hashes = {}
    for r in sorted(texts.simhash_docs(spark, sf).collect()):
        hashes.setdefault(r.simhash, []).append(r.doc_id)
    firsts = [(ids[0], h, len(ids)) for h, ids in hashes.items()]
    far = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    want = {(a, b, far(x, y), n, m) for a, x, n in firsts for b, y, m in firsts if a < b and far(x, y) <= 3}
    assert want and {tuple(r) for r in texts.simhash_groups(spark, sf).collect()} == want


def test_spread(spark, tmp_path):
    """A small table of one file is dealt over the cores, one of many files stays as it is."""
    from lodestar.sources import shared

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(9).write.parquet(str(tmp_path / "many"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(shared.spread(spark.read.parquet(str(tmp_path / "one")))) and shared.spread(spark.read.parquet(str(tmp_path / "one"))).count() == 1000
    assert "Repartition" not in plan(shared.spread(spark.read.parquet(str(tmp_path / "many"))))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_labels(spark):
    from pyspark.sql import functions as F

    lit = lambda x: F.lit(x).cast("long")
    assert [value(spark, X.run_duration(F.lit(s))) for s in (0, 4.32, 59.9, 60, 3725)] == ["0s", "4s", "59s", "1m 0s", "62m 5s"]
    now = 1706659200
    ages = (-5, 59, 60, 3599, 3600, 86399, 86400, 604799, 604800)
    assert [value(spark, X.ticker_age(lit(now - a), lit(now))) for a in ages] == ["방금", "방금", "1분 전", "59분 전", "1시간 전", "23시간 전", "1일 전", "6일 전", "2024-01-24"]
    days = [29, 30, 359, 360, 800]
    assert [value(spark, X.summary_age(lit(now - d * 86400), lit(now))) for d in days] == ["29일 전", "1개월 전", "11개월 전", "1년 전", "2년 전"]
    assert value(spark, X.summary_age(lit(None), lit(now))) == "—" and value(spark, X.summary_age(lit(now - 59), lit(now))) == "방금 전"
    assert [value(spark, X.clock_time(F.lit(t))) for t in (" 9:05 ", "23:59", "24:00", "9:5", "12:60", "x")] == ["09:05", "23:59", None, None, None, None]


def test_message_texts(spark):
    from pyspark.sql import functions as F

    assert value(spark, X.drop_think(F.lit(" <think>a\nb</THINK> yes <think>c</think>"))) == "yes"
    assert value(spark, X.json_slice(F.lit('say {"a": {"b": 1}} end } x'))) == '{"a": {"b": 1}} end }' and value(spark, X.json_slice(F.lit("none"))) == ""
    assert value(spark, X.added_urls(F.lit(" ADD <https://a.b/c|label>  http://x.y <https://q.r>"))) == ["https://a.b/c", "http://x.y", "https://q.r"]
    assert value(spark, X.added_urls(F.lit("remove http://x.y"))) == [] == value(spark, X.added_urls(F.lit(None).cast("string")))
    assert value(spark, X.escaped(F.lit("a & b <c>"))) == "a &amp; b &lt;c&gt;"
    terms = F.array(*map(F.lit, [" Rust ", "rust", 'a"b\'c\n', "", "x" * 80, *map(str, range(20))]))
    got = value(spark, X.normal_terms(terms))
    assert got[:3] == ["Rust", "abc", "x" * 64] and len(got) == 10


def test_times_and_addresses():
    assert X.utc_seconds("2024-01-02T10:00:00Z") == X.utc_seconds("2024-01-02T12:00:00+02:00") == X.utc_seconds("2024-01-02 10:00:00") == 1704189600
    assert X.utc_seconds("soon") is X.utc_seconds(None) is X.utc_seconds("") is None
    page = '<meta property="article:published_time" content="soon"><time datetime="2024-01-02T10:00:00Z">x</time><p>a</p>'
    assert X.page_fields(page)[2] == 1704189600
    from lodestar.operators.ingest import ADDRESS_SAMPLES

    assert [X.literally_safe(u) for u, _ in ADDRESS_SAMPLES] == [ok for _, ok in ADDRESS_SAMPLES] and not X.literally_safe(None) and not X.literally_safe("http://[bad/")


def test_first_page():
    from types import SimpleNamespace as Row

    from lodestar.operators import pages

    rows = [Row(id=i, domain=d, feed_score=s, eff_s=t) for i, d, s, t in [(1, "a", 0.9, 10), (2, "a", 0.8, 50), (3, "b", 0.7, 60), (4, "c", None, 70)]]
    assert pages.lead(rows, "latest", 3, 40) == ([1, 2, 3, 4], 1)
    assert pages.lead(rows, "recommended", 3, 40)[1] == 3
    assert pages.lead(rows, "recommended", 99, 40)[1] == 2  # not on the page: its best recent row
    assert pages.lead(rows, "recommended", 99, 100)[1] == 1 == pages.lead(rows, "recommended", None, 40)[1]
    assert pages.lead([], "recommended", None, 40) == ([], None)
    for key in ((1700000000, 7, 0.5), (1700000000, 7, None)):
        assert pages.decode_portfolio_cursor(pages.encode_portfolio_cursor(*key)) == (key[2], key[0], key[1])
    for bad in ("", "x", "e30", pages.encode_cursor("latest", 1, 2)):
        with pytest.raises(ValueError):
            pages.decode_portfolio_cursor(bad)


def test_choices():
    from lodestar.operators import reads

    assert reads.normalised("latest", "Alpha") == ("latest", "Alpha") and reads.normalised("x", "alpha") == ("recommended", None) == reads.normalised(None, None)


def test_pairs_by_blocks(spark, sf, monkeypatch):
    """Blocks and the broadcast side give the same pairs."""
    from lodestar.functions import vectors
    from lodestar.operators import ranking

    df = ranking.embedded(spark, sf)
    some = df.where("id % 3 = 0")
    pairs = lambda *a, **k: {(r.a, r.b): round(r.cosine, 6) for r in vectors.similar_pairs(*a, **k).collect()}
    want, both = pairs(df, df, 0.2, same=True), pairs(df, some, 0.2)
    monkeypatch.setattr(vectors, "BROADCAST_VALUES", 10)
    monkeypatch.setattr(vectors, "BLOCK", 17)
    assert want and pairs(df, df, 0.2, same=True) == want and pairs(df, some, 0.2) == both


def test_pages_read_no_texts(spark, sf):
    """Lists sort and filter without the text column; counts join no table that they don't need."""
    from lodestar.operators import reads

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan(reads.scored_items(spark, sf).orderBy("eff_s").limit(5))
    stats = plan(reads.stats_summary(spark, sf))
    assert not any(t in stats for t in ("embeddings.parquet", "pages.parquet", "labels.parquet"))
    assert "In(doc_id" in plan(reads.with_titles(reads.page(reads.T.items(spark, sf, "id"), reads.F.col("id"), limit=3), spark, sf))


def test_insert_missing(spark):
    from lodestar.operators import ingest

    target = spark.createDataFrame([("a", 0)], "k string, n int")
    batch = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), ("c", 4)], "k string, n int")
    assert sorted(map(tuple, ingest.insert_missing(target, batch, "k", "n").collect())) == [("b", 2), ("c", 4)]
    assert [r.k for r in ingest.without(batch, target, "k").orderBy("n").collect()] == ["b", "b", "c"]
    outcomes, after = ingest.toggled(spark.createDataFrame([(1, "Keep"), (2, "Archived")], "tech_id long, status string"), spark.createDataFrame([(1, "Keep", True), (2, "Keep", True), (3, "Keep", False), (4, "Keep", True)], "tech_id long, target string, active boolean"))
    assert {tuple(r) for r in outcomes.collect()} == {(1, "REMOVED", True), (2, "REMOVED", False), (3, "SET", False), (4, "REMOVED", False)}
    assert {tuple(r) for r in after.collect()} == {(2, "Archived"), (3, "Keep")}


def test_run_line(spark):
    from lodestar.operators import batch

    summary = spark.createDataFrame([(150, 100)], "queue_selected long, queue_remaining long")
    tallies = spark.createDataFrame([("rss", 5), ("hackernews", 2), ("github_trending", 9), ("arxiv", 1)], "source string, n long")
    assert tuple(batch.summary_line(summary, tallies).first()) == ("GitHub: 9, HN: 2, arxiv: 1, rss: 5", "150 / 250 (100)")


def test_item_detail(spark, sf):
    """A kept item shows its timeline, any other its alerts and history; neighbours are those of the whole table."""
    from lodestar.operators import ranking

    kept, other = ranking.item_detail(spark, sf, 20), ranking.item_detail(spark, sf, 2)
    assert set(kept) == {"predecessors", "successors", "similar", "timeline"} and set(other) == {"predecessors", "successors", "similar", "alerts", "history"}
    first = kept["timeline"].first()
    assert first.kind == "handoff" and first.ref in {r.other_id for r in kept["predecessors"].collect()}
    times = [r.at_s for r in kept["timeline"].collect()][1:]
    assert times == sorted(times, reverse=True) and all(f.count() >= 0 for f in other.values())


def test_stored_tables_go_unless_read(spark):
    with shared.recorded() as outer:
        first = shared.stored(spark.range(3), "first")
        with shared.recorded() as inner:
            second = shared.stored(spark.range(4), "second")
    later = shared.stored(spark.range(5), "later")
    assert len(outer) == 2 and inner == outer[1:]
    shared.drop_tables(spark, outer, second.where("id > 0"))
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        first.collect()
    assert (second.count(), later.count()) == (4, 5)
    shared.drop_tables(spark, outer)
    shared.drop_tables(spark, outer)
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        second.collect()
    assert later.count() == 5
