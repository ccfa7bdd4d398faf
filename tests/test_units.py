from datetime import date

import pytest
from pyspark.sql import functions as F

from quarryspark.api import Engine, RequestError, SearchRequest
from quarryspark.functions import text as T
from quarryspark.functions import urls as U
from quarryspark.operators import judge as J
from quarryspark.operators import retrieval as R
from quarryspark.operators import store as S
from quarryspark.sources import html, robots


def one(spark, f, s):
    return spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]


@pytest.mark.parametrize(("word", "stem"), [("queries", "query"), ("indexing", "index"), ("indexes", "index"), ("publicacoes", "publicacao"), ("claramente", "clara"), ("business", "business"), ("class", "class"), ("is", "is"), ("status", "status")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem, word) == stem


def test_fold_is_decomposition_without_marks(spark):
    """Every letter of the basic plane that decomposes to one letter and marks, composed and decomposed."""
    import unicodedata

    marks = set(map(chr, range(0x300, 0x370)))
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if c not in marks).lower()
    letters = [c for c in map(chr, (*range(0xC0, 0xAC00), *range(0xF900, 0xFFFE))) if len(plain(c)) == 1 and c.isalpha() and c not in "İẞ" and c.lower() == c]
    rows = spark.createDataFrame([(c, unicodedata.normalize("NFD", c)) for c in letters], "c string, d string").select(T.fold(F.col("c")).alias("c"), T.fold(F.col("d")).alias("d")).collect()
    assert [r["c"] for r in rows] == [plain(c) for c in letters] and [r["d"] for r in rows] == [plain(c) for c in letters]
    assert one(spark, T.fold, "Tiếng Ế ơ ǎ é") == "tieng e o a e"


def test_small_text_functions(spark):
    assert one(spark, T.strip_fence, "```json\n{}\n```") == "{}" and one(spark, T.strip_fence, " x ``` ") == "x ```"
    assert one(spark, T.first_json, 'so: {"a": 1} ok') == '{"a": 1}' and one(spark, T.first_json, "none") is None
    assert one(spark, lambda s: T.first_non_empty(s, F.lit("\t"), F.lit("x"), F.lit("y")), None) == "x"
    assert one(spark, T.content_terms, "The Résumé of that resume") == ["resume"]
    assert one(spark, lambda s: T.query_variants(s, F.array(F.lit("ab"), F.lit(" Buffer  pool "), F.lit("other way"), F.lit("third"), F.lit("fourth")), 3), "buffer pool") == ["buffer pool", "other way", "third"]
    assert U.absolute("../b?c", "https://x.org/a/d") == "https://x.org/b?c" and U.absolute("http://[", "https://x.org") == "http://["


def test_text(spark):
    assert one(spark, T.fold, "Saúde") == "saude"
    assert len(one(spark, T.sentences, "It cost 3.5 units. Dr. Lee agreed! Did it end?")) == 3
    assert one(spark, T.quoted, 'find "two words" here') == ["two words"]
    assert one(spark, T.raw_terms, "Use C++, c# and node.js.") == ["use", "c++", "c#", "and", "node.js"]
    assert one(spark, T.detect_language, "the cat is on the mat") == "en"
    assert one(spark, T.detect_language, "o que voce quer para mim") == "pt"
    assert one(spark, T.detect_language, "") == "und"


def test_urls(spark):
    assert one(spark, U.domain, "https://WWW.Example.org/a?b") == "example.org"
    assert one(spark, U.scope, "https://x.org/en/learn") == "/en/learn/"
    assert one(spark, U.scope, "https://x.org/") is None
    assert one(spark, U.scope, "https://x.org/a/b.html") is None
    assert one(spark, U.normalize_domain, "www.Example.org/path") == "example.org"


def test_bm25_ties_and_unknown_terms(spark):
    docs = spark.createDataFrame([(2, "buffer pool"), (1, "buffer pool"), (3, ""), (4, None)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "buffer"), (2, "zebra"), (3, None)], "item_id bigint, text string")
    found = [(r["item_id"], r["doc_id"]) for r in R.bm25(asked, docs).orderBy("item_id", "rank").collect()]
    assert found == [(1, 1), (1, 2)]


def test_simhash_and_near_pairs(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon"), (3, "wholly other words stand here"), (4, "")], "doc_id bigint, text string")
    h = {r["doc_id"]: r["simhash"] for r in R.simhash_bits(docs).collect()}
    assert h[1] == h[2] != h[3] and h[4] == "0" * 16


def test_route_order(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.9, 0.9, "include"), (2, 2, 0.0, 0.0, 0.9, 0.9, "exclude"), (3, 3, 0.9, 0.9, 0.9, 0.9, "exclude")], "item_id int, doc_id int, aff double, inj double, cov double, adv double, want string").withColumn("adv", F.lit(0.05))
    assert all(r["route"] == r["want"] for r in J.route(rows).collect())


def test_rate_limit_across_segments(spark):
    """Windows that cross segments of time, busy and lone keys, equal times, a null key; against a fold in plain Python."""
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(k, int(t), i) for i, (k, t) in enumerate([(int(k), int(t)) for k in range(5) for t in np.sort(r.integers(-5000, 40_000, [1, 40, 900, 3, 300][k]))] + [(None, 5), (None, 5), (None, 1200)])]
    want, state = {}, {}
    for k, t, i in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        start, used = state.get(k, (None, 0))
        start, used = (t, 1) if start is None or t - start >= 1000 else (start, used + 1)
        state[k], want[i] = (start, used), (k, used <= 3, used)
    frame = spark.createDataFrame(rows, "key bigint, t_ms bigint, id bigint").repartition(3)
    for segment in (1, 2, 16):
        assert {x["id"]: (x["key"], x["allowed"], x["used"]) for x in S.rate_limit(frame, 3, 1000, segment).collect()} == want


def test_rate_limit_where_a_join_becomes_a_broadcast(spark):
    """The last deal by segments is not left out where a join has dealt by the same columns: adaptive execution may make that join a broadcast."""
    rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 7).alias("key"), (F.col("id") * 10).alias("t_ms"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.rate_limit(rows, 3, 1000)
        assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 3
        assert {r["id"]: r["used"] for r in found.collect()} == {i: (i // 7) % 15 + 1 for i in range(4000)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_milliseconds_are_rounded(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:11.172499",), ("2024-01-01 00:00:11.1725",), ("2024-01-01 00:00:11.172999",)], "s string")
    assert [r[0] for r in rows.select(S.millis(F.col("s").cast("timestamp_ntz"))).collect()] == [1704067211172, 1704067211173, 1704067211173]


def test_near_pairs_by_every_scheme(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(2)
    base = int(r.integers(0, 2**63))
    values = {base} | {base ^ int(sum(1 << int(b) for b in r.choice(64, 1 + i % 7, replace=False))) for i in range(60)}
    rows = list(enumerate(sorted(values)))
    want = {(i, j) for i, a in rows for j, b in rows if i < j and (a ^ b).bit_count() <= 5}
    frame = spark.createDataFrame([(i, f"{v:016x}") for i, v in rows], "doc_id bigint, simhash string")
    for b, t in R.SCHEMES:
        monkeypatch.setattr(R, "scheme", lambda n, most, b=b, t=t: (b, t))
        assert {(x["a"], x["b"]) for x in R.near_pairs(frame).collect()} == want
    assert R.SCHEMES[0] == (6, 1)


def test_texts_containing_phrases(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "xone two three four fivex"), (3, "two  three"), (4, None), (5, "one two three four five; one two three four five")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "one two three four five"), (2, "three"), (3, ""), (4, None), (5, "o thre"), (6, "two three four five six seven")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in R.containing(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (1, 2), (2, 2), (3, 2), (5, 2), (1, 3), (2, 3), (3, 3), (5, 3), (1, 5), (2, 5), (5, 5)}


def test_dense_of_ragged_and_empty_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0, 5.0]), (6, [1.0, 0.0])], "doc_id bigint, vector array<double>").repartition(2)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0])], "item_id bigint, vector array<double>")
    for per_pass in (100, 1):
        got = {r["item_id"]: [] for r in asked.collect()}
        for r in R.dense(asked, vectors, 4, per_pass).orderBy("item_id", "rank").collect():
            got[r["item_id"]].append((r["doc_id"], r["score"]))
        assert got[1] == [(1, 1.0), (3, 1.0), (6, 1.0), (5, 0.707107)] and got[2][0] == (5, 0.707107) and all(s == 0 for _, s in got[2][1:])


def test_rate_limit_edges(spark):
    rows = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 1, 2, 3, 59_999, 60_000])], "key bigint, t_ms bigint, id bigint")
    assert [r["allowed"] for r in S.rate_limit(rows, 3, 60_000).orderBy("id").collect()] == [True, True, True, False, False, True]


def test_aliases_end_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")], "from_url string, to_url string")
    got = {r["url"]: r["target"] for r in S.resolve_aliases(edges.select(F.col("from_url").alias("url")), edges).collect()}
    assert got == {"a": "c", "b": "a", "c": "b", "x": "x"}


def test_robots(spark):
    files = spark.createDataFrame([("h", "User-agent: mine\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /\nSitemap: https://h/map.xml")], "host string, body string")
    urls = spark.createDataFrame([("h", "/private/a"), ("h", "/private/open/a"), ("h", "/b"), ("g", "/c")], "host string, path string")
    assert {r["path"]: r["allow"] for r in robots.allowed(urls, files, "mine").collect()} == {"/private/a": False, "/private/open/a": True, "/b": True, "/c": True}
    assert robots.crawl_delays(files, "mine/3.1").first()["crawl_delay_ms"] == 2000
    assert robots.sitemaps(files, "mine").first()["sitemap"] == "https://h/map.xml"
    assert not robots.allowed(urls, files, "yours").where("host = 'h' and allow").count()


def test_html():
    page = html.read("<body><main><p>" + "word " * 50 + "</p></main><div class=content>" + "<a href=/x>link</a>" * 100 + "</div><img src=/no.png></body>", "https://x.org/d/")
    assert page["text"].startswith("word") and "link" not in page["text"] and page["links"][0] == "https://x.org/x" and page["images"] == []
    page = html.read("<article><h2>Top</h2><ul><li>one <b>bold</b></li><li>two</li></ul><pre>x\n y</pre><p><a href='a'>A</a><a href='b'></a> " + "t " * 150 + "</p><img src='p.png' alt='P'><script>no</script></article>", "https://x.org/")
    assert page["text"].startswith("## Top\n\n- one **bold**\n- two\n\n```\nx\n y\n```\n\n[A](https://x.org/a) t t") and page["images"] == [{"url": "https://x.org/p.png", "alt": "P"}]
    page = html.read("<html lang=en><head><title>T</title><meta property='article:published_time' content='2024-01-02'></head><body><nav>menu</nav><article><h1>Head</h1><p>" + "word " * 60 + "</p></article><footer>foot</footer></body></html>")
    assert page["title"] == "T" and page["published"] == "2024-01-02" and "menu" not in page["text"] and page["text"].startswith("# Head")
    assert html.read("<div><p>broken").get("text") == "broken" and html.read(None)["text"] == "" and html.read("<![x")["title"] == ""


@pytest.mark.parametrize("body", [{}, {"query": "q", "odd": 1}, {"query": "q", "max_results": 99}, {"query": "q", "start_date": "2024-02-01", "end_date": "2024-01-01"}, {"query": "q", "filter_by_language": True}])
def test_bad_requests(body):
    with pytest.raises(RequestError):
        SearchRequest.parse(body)


def test_engine(spark, sf):
    from quarryspark.plans.catalog import Tables

    t = Tables(spark, sf)
    e = Engine(spark, t.dated, t.vectors)
    text = t.benchmark.first()["text"]
    assert e.search([{"query": text, "max_results": 3}], date(2024, 6, 1)).count() <= 3
    assert e.extract(t.pages).where("status = 'ok'").count() > 0 and e.stats().first()["docs"] == 200


def test_streams_equal_batches(spark, sf, tmp_path):
    from quarryspark.plans.catalog import QUERIES
    from quarryspark.streaming.limiter import limited

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), F.col("event_id").alias("id"))
    events.repartitionByRange(2, "t_ms").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = limited(stream, 3, 6 * 3600 * 1000).writeStream.format("memory").queryName("limited").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination()
    batch = QUERIES["rate_limit"](spark, sf)
    assert spark.table("limited").count() == batch.count() and spark.table("limited").exceptAll(batch.select("key", "id", "allowed", "used")).count() == 0


def test_session_leaves_a_running_ones_settings(spark):
    from quarryspark.session import session, submitted

    assert "spark.master" in submitted()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    again = session()
    assert again.conf.get("spark.sql.shuffle.partitions") == before and again.sparkContext.master == spark.sparkContext.master


def test_settings():
    from quarryspark import config

    c = config.load({"QUARRY_MAX_RESULTS": "5", "QUARRY_HYBRID": "off"})
    assert c.max_results == 5 and not c.hybrid and c.crawl_concurrency == 4 and config.engine(c) is None
    for env in ({"QUARRY_CRAWL_CONCURRENCY": "0"}, {"QUARRY_HYBRID": "maybe"}, {"QUARRY_DECISION_PROVIDER": "x"}):
        with pytest.raises(ValueError):
            config.load(env)
    with pytest.raises(ValueError):
        config.engine(config.load({"QUARRY_DECISION_PROVIDER": "chat"}))
    assert config.engine(config.load({"QUARRY_DECISION_KEY": "k", "QUARRY_DECISION_URL": "http://x"})).name == "remote"


def test_request_bodies():
    from quarryspark.api import log_line, parse_body, redacted

    assert parse_body("extract", {"urls": "https://x.org/a"})["urls"] == ["https://x.org/a"] and parse_body("crawl", {"url": "http://x.org"})["mode"] == "page"
    bad = [("extract", {"urls": []}), ("extract", {"urls": ["ftp://x"]}), ("extract", {}), ("crawl", {"url": "http://x.org", "max_depth": 7}), ("crawl", {"url": "http://x.org", "odd": 1}), ("index", {"urls": ["http://x.org"] * 51}), ("evaluate", {"state": {}, "questions": {}}), ("evaluate", {"questions": {"a": {"type": "noul"}}})]
    for kind, body in bad:
        with pytest.raises(RequestError):
            parse_body(kind, body)
    assert redacted({"a": 1, "trace": 2}) == {"a": 1} and log_line("debug", "x") is None and '"n": 1' in log_line("warn", "x", n=1)


def test_decisions(spark):
    """Equal states are asked once, failures give defaults that are marked, and the cache answers until it is old."""
    from quarryspark.operators import decision as D

    class Sour:
        name, calibrated = "sour", False

        def evaluate(self, state, questions):
            if "bad" in state:
                raise OSError("down")
            return D.Reply({"relevant": D.Answer(noul=0.9)}, 10, 2, 1, 0.5)

    questions = [D.Question("relevant", "noul"), D.Question("shape", "choice", options=("a", "b"))]
    states = spark.createDataFrame([(1, '"x"'), (2, '"x"'), (3, '"bad"')], "state_id bigint, state string")
    got = D.decide(states, questions, Sour())
    rows = {(r["state_id"], r["question"]): r for r in got.collect()}
    assert rows[1, "relevant"]["noul"] == 0.9 == rows[2, "relevant"]["noul"] and not rows[1, "relevant"]["degraded"] and rows[1, "shape"]["degraded"]
    assert rows[3, "relevant"]["noul"] == 0.5 and {r["state_id"] for r in D.degraded(got).collect()} == {1, 2, 3}
    assert got.dropDuplicates(["key", "question"]).agg(F.sum("input_tokens")).first()[0] == 10
    cache = got.drop("state_id", "cached").dropDuplicates(["key", "question"]).withColumn("asked_ms", F.lit(1000).cast("long"))
    cache = spark.createDataFrame(cache.collect(), cache.schema)
    again = D.decide(states, questions[:1], Sour(), cache, now_ms=2000)
    assert again.count() == 3
    one_question = [D.Question("relevant", "noul")]
    kept = D.decide(states, one_question, Sour()).drop("state_id", "cached").dropDuplicates(["key", "question"]).withColumn("asked_ms", F.lit(1000).cast("long"))
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    for now, cached in ((2000, True), (10**9, False)):
        rows = {r["state_id"]: r for r in D.decide(states, one_question, Sour(), kept, now_ms=now).collect()}
        assert rows[1]["cached"] == cached and not rows[3]["cached"] and rows[1]["noul"] == 0.9
    assert {r["state_id"]: r["noul"] for r in D.noul(got, "relevant").collect()} == {1: 0.9, 2: 0.9, 3: 0.5}


def test_remote_engines():
    from quarryspark.operators import decision as D

    calls, waits = [], []
    replies = [(529, {}), (200, {"answers": {"a": {"noul": 3}, "b": {"probabilities": {"y": 3}}, "c": {"probabilities": {"1": 1, "2": 1}}}, "usage": {"input_tokens": 7}})]
    engine = D.Remote("http://x", "k", cost_per_token=0.1, post=lambda *x: (calls.append(x), replies[len(calls) - 1])[1], wait=waits.append)
    asked = [D.Question("a", "noul"), D.Question("b", "choice", options=("x", "y")), D.Question("c", "score", options=("l", "m", "h")), D.Question("d", "noul")]
    got = engine.evaluate('{"q": 1}', asked)
    assert got.answers["a"].noul == 1 and got.answers["b"].choice == "y" and got.answers["c"].score == 1.5 and "d" not in got.answers
    assert got.requests == 2 and abs(got.cost_usd - 0.7) < 1e-9 and waits == [0.25] and calls[0][2] == {"Authorization": "Bearer k"}
    with pytest.raises(RuntimeError):
        D.Remote("http://x", post=lambda *x: (404, {}), wait=waits.append).evaluate("{}", asked)
    chat = D.Chat("http://x", post=lambda *x: (200, {"choices": [{"message": {"content": "```json\n{\"a\": 0.2}\n```"}}]}))
    assert chat.evaluate("{}", asked[:1]).answers["a"].noul == 0.2 and not chat.calibrated
    assert [D.backoff(i) for i in (1, 2, 5, 9)] == [0.25, 0.5, 4.0, 4.0] and D.proxy_confidence(0.75) == 0.5 and D.pick({}, ["a", "b"]) == {"a": 0.5, "b": 0.5}
    assert D.flat_state({"query": "no", "x": ["a", {"claim": "no", "y": "b"}]}) == "a\nb" and D.entropy_confidence({"a": 0.5, "b": 0.5}) == 0
    assert {len(v) for v in D.CATALOG.values()} == {11, 6, 5, 2, 1} and D.single("x?")[0].kind == "noul"


def test_crawl(spark):
    """A site of four pages, one refused, one broken: rounds end, the budget holds, links stay in the folder."""
    from quarryspark import crawl

    page = lambda links: "<html><body><article><h1>T</h1><p>" + "words that fill a page " * 20 + "".join(f"<a href='{x}'>go there</a> " for x in links) + "</p></article></body></html>"
    web = spark.createDataFrame(
        [("https://x.org/d/a", 200, "text/html", page(["https://x.org/d/b", "https://x.org/d/no", "https://x.org/out", "https://y.org/d/z"])), ("https://x.org/d/b", 200, "text/html", page(["https://x.org/d/a", "https://x.org/d/c"])), ("https://x.org/d/c", 500, "text/html", ""), ("https://x.org/d/e", 200, "image/png", "")],
        "url string, status int, content_type string, html string",
    )
    files = spark.createDataFrame([("x.org", "User-agent: *\nDisallow: /d/no")], "host string, body string")
    maps = spark.createDataFrame([("r", "https://x.org/d/e"), ("r", "https://x.org/other")], "root string, loc string")
    state, folder = crawl.seeded(crawl.start(spark), "https://x.org/d/a", maps)
    assert folder is None or folder == "/d/a/"
    rounds = []
    end = crawl.drain(state, lambda urls: web.join(urls, "url"), files, "/d/", places=2, on_round=lambda n, rows: rounds.append(n))
    got = {r["url"]: (r["status"], r["reason"]) for r in end.outcomes.collect()}
    assert got["https://x.org/d/a"] == ("indexed", None) == got["https://x.org/d/b"] and got["https://x.org/d/no"] == ("skipped", "refused by robots")
    assert got["https://x.org/d/c"] == ("error", "status 500") and "https://x.org/out" not in got and "https://y.org/d/z" not in got
    assert {r["url"] for r in end.docs.collect()} == {"https://x.org/d/a", "https://x.org/d/b"} and end.queue.where("status in ('pending', 'active')").count() == 0
    assert crawl.drain(state, lambda urls: web.join(urls, "url"), budget=1, places=4).outcomes.count() == 1


def test_index_is_replaced_without_a_trace(spark):
    from quarryspark.operators.index import Index

    docs = spark.createDataFrame([(1, "buffer pool"), (2, "buffer"), (3, None)], "doc_id bigint, text string")
    index = Index.build(docs)
    asked = spark.createDataFrame([(1, "buffer"), (2, "pool latch"), (3, "")], "item_id bigint, text string")
    ids = lambda x: {(r["item_id"], r["doc_id"]) for r in x.bm25(asked).collect()}
    assert ids(index) == {(1, 1), (1, 2), (2, 1)} and index.docs == 3
    changed = index.replaced(spark.createDataFrame([(1, "latch")], "doc_id bigint, text string"), spark.createDataFrame([(2,)], "doc_id bigint"), docs)
    assert ids(changed) == {(2, 1)} and changed.docs == 2 and Index(spark, changed.path).avg_length == changed.avg_length
    assert index.hits(spark.createDataFrame([], "item_id bigint, term string")).count() == 0


def test_guard_refuses_to_measure(spark):
    from quarryspark.operators import evaluate as E

    docs = spark.createDataFrame([("https://x/a",)], "url string")
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    E.guard(labels.where("label = 'a'"), docs, F.expr("contains(url, label)"))
    with pytest.raises(LookupError, match="b"):
        E.guard(labels, docs, F.expr("contains(url, label)"))


def test_index_agrees_with_the_tokenizer(spark, sf):
    """One pass by tasks gives the terms, lengths, frequencies and fingerprints of the text functions, and the scores of a plain read."""
    from quarryspark.operators.index import Index

    odd = [(-1, None), (-2, ""), (-3, "Éa\u0301 İstanbul ΣΑΣ naïve Ünï-cödé C++ c# node.js ... deve-se mentes claramente boxes publicacoes " + "x" * 41), (-4, "the of a"), (-5, "ÀÉ ﬁsh ǅ Straße 한글 ١٢ a_b. x")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    index = Index.build(docs)
    rows = lambda x: {tuple(r) for r in x.collect()}
    one = index.documents.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc_id", "x.terms", F.col("x.tfs").cast("long"))
    assert rows(one) == rows(R.postings(docs)) and rows(index.documents.select("doc_id", "dl")) == rows(R.lengths(docs)) and rows(index.hashes()) == rows(R.simhash_bits(docs))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    assert rows(index.bm25(asked, 7)) == rows(R.bm25(asked, docs, 7))
    n, best = index.scores(asked).count(), index.totals(asked).agg(F.sum("n"), F.max("best")).first()
    assert n == best[0] and best[1] == R.bm25(asked, docs, 1).agg(F.max("score")).first()[0]
    assert "Exchange" not in index.scores(asked)._jdf.queryExecution().executedPlan().toString()  # pairs of query and document are not shuffled


def test_phrases_meet_texts_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(R, "PHRASES_PER_PASS", 2)
    docs = spark.createDataFrame([(i, f"begin word{i} one two three word{i + 1} end") for i in range(6)] + [(9, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(f"i{i}", f"ord{i} one two three word{i + 1} e") for i in range(5)] + [("e", ""), ("n", None)], "item_id string, text string")
    found = R.containing(docs, items)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(i, f"i{i}") for i in range(5)} | {(i, "e") for i in range(6)}


def test_fingerprints_are_made_for_the_pool_alone(spark, sf):
    """An index without fingerprints gives the same candidates, given the texts; fingerprints of texts are those of the text functions, over runs of 60 words too."""
    from quarryspark.operators.index import Index, fingerprints
    from quarryspark.plans import search as P

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "one"), (-3, "x y " * 200 + "z"), (-4, f"{'ab' * 20} {'éü' * 20} {'ñ' * 40}")], "doc_id bigint, text string"))
    rows = lambda x: {tuple(r) for r in x.collect()}
    assert rows(fingerprints(docs)) == rows(R.simhash_bits(docs))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").limit(20)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    bare = Index.build(docs, simhash=False)
    assert "simhash" not in bare.documents.columns
    assert rows(P.candidates(asked, bare, vectors, texts=docs)) == rows(P.candidates(asked, Index.build(docs), vectors))


def test_near_pairs_come_once_without_a_shuffle_of_pairs(spark):
    """Pairs within 5 bits, by every scheme, as brute force finds them; a pair that agrees in many keys comes from one of them."""
    import random

    from quarryspark.operators.index import _heads

    r = random.Random(5)
    hs = {0, 2**64 - 1, 2**63, 2**63 + 1}
    for _ in range(40):
        h = r.getrandbits(64)
        hs |= {h} | {h ^ sum(1 << b for b in r.sample(range(64), n)) for n in (1, 2, 4, 5, 6)}
    hs = sorted(hs)
    want = {(i, j, (x ^ y).bit_count()) for i, x in enumerate(hs) for j, y in enumerate(hs) if i < j and (x ^ y).bit_count() <= 5}
    frame = spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(hs)], "doc_id bigint, simhash string").coalesce(1)
    for n in (10, 10**6, 10**8):
        found = R.near_pairs(frame, rows=n)
        got = [tuple(x) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    import hashlib

    import pyarrow as pa

    grams = [bytes(r.randrange(256) for _ in range(n)) for n in (*range(130), 55, 56)]
    assert _heads(pa.array(grams, pa.binary())).tobytes() == b"".join(hashlib.sha1(g).digest()[:8] for g in grams)


def test_index_for_a_batch_answers_as_the_whole_one(spark, sf, monkeypatch):
    from quarryspark.operators import index as I

    odd = ["", None, "Ponies pony PONIES, running runs -run- boxes box", "naïve—Café…CAFÉ cafe\u0301 ΣΟΦΟΣ 数据 データ x", "acao acoes c++ C# node.js ._- a the I " + "w" * 40 + " " + "w" * 41, "lentamente lenta lentas his hi his", "a", "\u00a0box\u2028pony\u3000run", "bo\0x box\x7fpony", "🙂box🙂 ÀÉ é"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, 10**6)), "doc_id bigint, text string"))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(("pony box run", "cafe naive σοφος 数据 データ", "acao c++ c# node.js a lenta hi the x", "w" * 40, "e ae", ""))], "item_id bigint, text string"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = I.Index.build(docs, simhash=False)
    monkeypatch.setattr(I, "BYTES_AT_ONCE", 1_000)
    batch = I.Index.build(docs, queries=asked)
    assert rows(batch.documents.select("doc_id", "dl")) == rows(whole.documents.select("doc_id", "dl")) and (batch.docs, batch.avg_length) == (whole.docs, whole.avg_length)
    terms = asked.select(F.explode(T.query_terms(F.col("text"))).alias("term")).distinct()
    assert rows(batch.terms) == rows(whole.terms.join(terms, "term", "left_semi"))
    ask = asked.select("item_id", F.explode(T.query_terms(F.col("text"))).alias("term"))
    columns = ["item_id", "doc_id", "term", "tf", "dl", "df"]
    assert rows(batch.hits(ask).select(columns)) == rows(whole.hits(ask).select(columns)) and rows(batch.scores(asked)) == rows(whole.scores(asked))
    monkeypatch.setattr(I, "MOST_TERMS", 5)  # more terms than fit: all of them are indexed
    assert rows(I.Index.build(docs, queries=asked).terms) == rows(whole.terms)


def test_texts_are_read_once_after_retrieval(spark, sf):
    from quarryspark.plans.catalog import QUERIES

    for name in ("shape_results", "extractive_answer", "rerank_composite"):
        assert not any(x.endswith("documents.parquet") for x in QUERIES[name](spark, sf).inputFiles())


def test_large_tables_are_not_dealt_out_anew(spark, sf, monkeypatch):
    from quarryspark.plans import catalog as C

    parts = lambda: C.Tables(spark, sf).documents.rdd.getNumPartitions()
    assert parts() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(C, "SMALL", 0)
    assert parts() == spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions()


def test_phrases_are_looked_up_by_bytes(spark, monkeypatch):
    """As brute force finds them, whatever the block's size, over texts that end within a character's bytes of one another; words aren't cut for it."""
    import random

    r = random.Random(7)
    text = lambda n: "".join(r.choices(r.choice(("ab", "abcé ", "a🙂ñ ")), k=n))
    docs = [(i, text(r.choice((0, 1, 8, 30, 90)))) for i in range(60)]
    items = [(i, text(r.choice((0, 2, 7, 8, 9, 15, 16, 17)))) for i in range(40)] + [(100 + i, s[2:-1]) for i, s in docs] + [(200 + i, s) for i, s in docs]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, text string")
    for size in (1, 40, 1_000_000):
        monkeypatch.setattr(R, "BYTES_AT_ONCE", size)
        found = R.containing(frame(docs, "doc_id"), frame(items, "item_id"))
        assert "split" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = [tuple(x) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, s in docs for j, q in items if q in s}


def test_accents_of_latin_letters_go_by_columns(spark):
    """Runs with accented Latin-1 letters become ASCII before words are looked up; the index is that of all terms still."""
    import pyarrow as pa

    from quarryspark.operators import index as I

    of, runs = I._runs(pa.array(["CAFÉ naïve", "é", "", "Ñandú×ß. 数é"]), 0, 4)
    assert of.tolist() == [0, 0, 1, 3, 3] and [x.decode() for x in runs.to_pylist()] == ["cafe", "naive", "e", "nandu×ß.", "数e"]
    letters = [chr(c) for c in range(0x80, 0x250)]
    texts = [f"x{c}y {c} {c}s é{c}́Ý. {c}{c.upper()}-ÀS" for c in letters] + ["É" * 40 + " " + "é" * 41, "canções caçoes CANÇÕES"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    asked = docs.withColumnRenamed("doc_id", "item_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole, batch = I.Index.build(docs, simhash=False), I.Index.build(docs, queries=asked)
    assert rows(batch.documents.select("doc_id", "dl")) == rows(whole.documents.select("doc_id", "dl"))
    terms = asked.select(F.explode(T.query_terms(F.col("text"))).alias("term")).distinct()
    assert rows(batch.terms) == rows(whole.terms.join(terms, "term", "left_semi"))
