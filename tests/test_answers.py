from datetime import date

import pytest
from pyspark.sql import functions as F

from quarryspark.api import Engine, RequestError, SearchRequest
from quarryspark.functions import markdown as M
from quarryspark.operators import answer as A
from quarryspark.operators import chunks as C
from quarryspark.operators import store as S
from quarryspark.operators import understand as Q
from quarryspark.plans import search as P
from quarryspark.sources.files import text_folder


def one(spark, f, s):
    return spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]


def test_sections_follow_headings():
    found = list(C.sections("intro\n# A\na\n## B\nb\n### C\n```\n# no heading\n```\n## D\nd"))
    assert [p for p, _ in found] == [[], ["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]
    assert "# no heading" in found[3][1]


def test_groups_merge_under_one_top_heading():
    found = C.grouped(C.sections("# A\na\n## B\nb\n# E\ne"))
    assert [p for p, _ in found] == [["A"], ["E"]] and "**B**" in found[0][1]
    assert len(C.grouped(C.sections("# A\n" + "a " * 900 + "\n## B\nb"))) == 2


def test_chunks(spark):
    rows = [("u", "Guide", "# Guide\nShort text here.\n## Part\nMore text there."), ("v", None, None), ("w", "T", "  \n "), ("x", "T", "#"), ("y", "T", "One sentence of words. " * 200)]
    docs = spark.createDataFrame(rows, "url string, title string, markdown string")
    found = C.chunk_documents(docs).orderBy("url", "ord").collect()
    assert [(r["url"], r["heading_path"]) for r in found if r["url"] == "u"] == [("u", ["Guide"])]
    assert not any(r["url"] in "vw" for r in found) and all(r["text"] for r in found)
    long = [r for r in found if r["url"] == "y"]
    assert [r["ord"] for r in long] == list(range(len(long))) and all(r["tokens"] <= 400 for r in long) and len({r["id"] for r in found}) == len(found)
    again = C.chunk_documents(docs).orderBy("url", "ord").collect()
    assert again == found


@pytest.mark.parametrize(("said", "want"), [("2025-02-09", "2025-02-09"), ("Sun, 09 Feb 2025 10:00:00 GMT", "2025-02-09"), ("2025-02", "2025-02-01"), ("2025", "2025-01-01"), ("last spring", None), ("", None), (None, None)])
def test_dates(spark, said, want):
    found = one(spark, lambda s: F.date_format(M.normal_date(s), "yyyy-MM-dd"), said)
    assert found == want


def test_markdown(spark):
    assert one(spark, M.strip_markdown, "# Head\n\n- see [this](http://x/y) and `code`\n```\nhidden\n```\n| a | b") == "Head see this and a | b"
    assert one(spark, M.cleanup_markdown, "a ![p](data:image/png;base64,xx) [](http://x)\n\n\n\nb") == "a  \n\nb"
    assert one(spark, lambda s: M.with_title(s, F.lit("T")), "body") == "# T\n\nbody" and one(spark, lambda s: M.with_title(s, F.lit("T")), "# X\nbody") == "# X\nbody"
    assert one(spark, M.internal_links, "[a](http://x/1#f) [b](http://x/1) [c](/rel)") == ["http://x/1"]


def test_levels_and_confidence(spark):
    row = spark.range(1).select(Q.spread(4, F.lit(0.0)).alias("p"), Q.expected_level(3, F.lit(1.0)).alias("e"), Q.entropy_confidence(F.array(F.lit(0.5), F.lit(0.5))).alias("even"), Q.entropy_confidence(F.array(F.lit(1.0), F.lit(0.0))).alias("sure")).first()
    assert abs(sum(row["p"]) - 1) < 1e-9 and row["p"][0] == max(row["p"]) and row["e"] > 1.5 and row["even"] == 0 and row["sure"] == 1


def test_understanding_obeys_the_caller(spark):
    asked = spark.createDataFrame([(1, 'find "two words"'), (2, None)], "item_id bigint, text string")
    a, b = Q.understand(asked, "advanced", pool=10, max_rounds=3).orderBy("item_id").collect()
    assert a["exact_phrase"] and not b["exact_phrase"] and a["depth"] == "advanced" and a["pool"] in (10, 14) and a["rounds"] == 3
    assert Q.understand(asked, auto=True).first()["depth"] in Q.DEPTHS


def test_follow_ups(spark):
    titles = F.array(F.lit("Buffer pools explained - Site"), F.lit("short"), F.lit("the query itself"), F.lit("Third title of some length"))
    assert one(spark, lambda s: P.follow_ups(s, titles), "The query itself") == ["Buffer pools explained", "Third title of some length"]


def test_second_round_adds_after_the_first(spark):
    docs = spark.createDataFrame([(1, "buffer pools", "Latch protocols at length"), (2, "latch protocols", "Other"), (3, "zebra", "No")], "doc_id bigint, text string, title string")
    first = spark.createDataFrame([(7, 1, 1)], "item_id bigint, doc_id bigint, rank int")
    asked = spark.createDataFrame([(7, "buffer")], "item_id bigint, text string")
    found = [(r["doc_id"], r["round"], r["rank"]) for r in P.second_round(asked, docs, first).orderBy("rank").collect()]
    assert found == [(1, 1, 1), (2, 2, 2)]


def test_spans_and_answers(spark):
    docs = spark.createDataFrame([(1, "Nothing of interest stands in this one. The buffer pool keeps pages in memory for reuse.")], "doc_id bigint, text string")
    page = spark.createDataFrame([(5, 1, 1, "include"), (5, 2, 9, "conflicting")], "item_id bigint, position int, doc_id bigint, route string")
    asked = spark.createDataFrame([(5, "buffer pool pages"), (6, "other")], "item_id bigint, text string")
    claim = A.claims(page, asked, docs).collect()
    assert len(claim) == 1 and claim[0]["claim"].startswith("The buffer pool") and claim[0]["overlap"] == 3
    five, six = A.write(A.claims(page, asked, docs), asked).orderBy("item_id").collect()
    assert five["answer"].endswith("[1]") and six["answer"] is None and six["n_claims"] == 0


def test_queue_caps_and_admission(spark):
    queue = spark.createDataFrame([("a", "active", None), ("b", "pending", None)], "url string, status string, error string")
    done = spark.createDataFrame([("a", "error", "timeout")], "url string, status string, error string")
    assert {(r["url"], r["status"], r["error"]) for r in S.complete(queue, done).collect()} == {("a", "error", "timeout"), ("b", "pending", None)}
    calls = spark.createDataFrame([("k", 0, 1), ("k", 1, 2), ("no", 2, 3)], "key string, t_ms bigint, id bigint")
    assert {(r["id"], r["status"]) for r in S.admit(calls, spark.createDataFrame([("k",)], "key string"), 1, 1000).collect()} == {(1, 200), (2, 429), (3, 401)}


def test_text_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a page.md").write_text("# A\nbody")
    (tmp_path / "b.bin").write_text("no")
    assert [(r["title"], r["markdown"]) for r in text_folder(spark, str(tmp_path)).collect()] == [("a page", "# A\nbody")]


def test_engine_answers(spark):
    text = "The buffer pool keeps pages in memory so that reads of hot pages need no disk. " * 3
    docs = spark.createDataFrame([(1, text, "docs.example.org", "en", None, "Buffer pools"), (2, "Unrelated words about gardens.", "b.org", "en", None, "Gardens")], "doc_id bigint, text string, host string, lang string, published date, title string")
    engine = Engine(spark, docs)
    found = engine.search([{"query": "buffer pool pages memory", "include_raw_content": True, "max_rounds": 2}], date(2024, 1, 1)).collect()
    assert [r["doc_id"] for r in found] == [1] and found[0]["raw_content"].startswith("The buffer")
    row = engine.answer([{"query": "buffer pool pages memory"}], date(2024, 1, 1)).first()
    assert row["reason"] is not None or "[1]" in row["answer"]
    with pytest.raises(RequestError):
        SearchRequest.parse({"query": "x", "max_rounds": 9})


def test_follow_ups_are_not_made_distinct(spark):
    row = spark.createDataFrame([("asked", "a long title | x", "a long title | y")], "q string, a string, b string")
    assert row.select(P.follow_ups(F.col("q"), F.array("a", "b", "a"))).first()[0] == ["a long title", "a long title"]
