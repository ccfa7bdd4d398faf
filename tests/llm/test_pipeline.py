from collections import Counter

import corpus_pipeline
from quarryspark.llm import decontaminate, exact_dedup, langid, minhash

from ..compare import duck
from .test_operators import brute_classes, pairs


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name != "packing":
            assert after.columns == columns
        if name == "exact_dedup":
            text = {}
            for i, t in pairs(before):
                key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
                text[key] = max(i, text.get(key, i))
            assert ids == set(text.values())
        elif name == "near_dedup":
            rows = pairs(before)
            assert ids == {i for (i, _), c in zip(rows, brute_classes(rows)) if i == c}
        elif name == "decontamination":
            bad = set(duck(decontaminate.SQL, sf)["doc_id"].tolist())
            assert ids == {i for i, _ in pairs(before)} - bad
        elif name == "packing":
            assert ids == {i for i, _ in pairs(before)}
        else:
            assert len(ids) >= 0.95 * before.count()
        before = after
    assert corpus_pipeline.run(spark, sf).count() == before.count() and exact_dedup.SQL


#: Rows that share ids or have none; columns whose names the operators use themselves.
SHARED = [(5, "same text here"), (9, "Same text here"), (5, "quite other words"), (None, "same text here"), (None, None), (None, "words without an id"), (7, ""), (7, "seven words in all"), (8, "a benchmark line of words")]


def shared_ids(spark, rows=SHARED):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, mark int, kept int, class_id int, block int, at int, row int, q int, i int, part int"
    return spark.createDataFrame([(i, t, "en", "src", k, *range(9)) for k, (i, t) in enumerate(rows)], kind).repartition(3)


def left(frame, columns):
    assert frame.columns == columns
    return Counter((r["doc_id"], r["text"]) for r in frame.collect())


def test_stages_tell_rows_of_one_id_apart(spark, tmp_path):
    docs = shared_ids(spark)
    all_rows = Counter(SHARED)
    docs.write.parquet(str(tmp_path / "docs"))
    for frame in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        for parts in (1, 3):
            assert left(exact_dedup.drop_exact(frame, parts), docs.columns) == Counter([(9, "Same text here"), (5, "quite other words"), (None, "words without an id"), (7, ""), (7, "seven words in all"), (8, "a benchmark line of words")])
        assert left(minhash.drop_near(frame), docs.columns) == all_rows - Counter([(9, "Same text here"), (None, "same text here")])
        items = spark.createDataFrame([(1, "benchmark line"), (None, "seven words"), (2, None)], "item_id bigint, text string")
        assert left(decontaminate.drop_contaminated(frame, items), docs.columns) == all_rows - Counter([(7, "seven words in all"), (8, "a benchmark line of words")])
        assert left(langid.drop_unknown(frame), docs.columns) <= all_rows - Counter([(None, None), (7, "")])


def test_repeated_rows_stay_once(spark):
    got = exact_dedup.drop_exact(shared_ids(spark, [(4, "x y"), (4, "X y"), (4, "x y"), (3, "x y")]))
    assert got.count() == 1 and got.first()["doc_id"] == 4


def test_stages_on_empty_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
