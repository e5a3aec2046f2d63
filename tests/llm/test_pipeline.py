"""The pipeline's stages against brute force, stage by stage."""

import corpus_pipeline
from rasterlake.llm import decontam, pii, quality_rules

from .test_decontam import brute as hits
from .test_decontam import plain_words
from .test_simhash import brute as classes
from .test_simhash import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), plain_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        before, after = docs.collect(), spark.read.parquet(str(tmp_path / str(k)))
        docs = after
        rows = after.collect()
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.query(spark, SF).where("kept").collect()}
            assert {r.doc_id for r in rows} == kept
        elif name == "simhash_near_dedup":
            assert {str(r.doc_id) for r in rows} == {c for _, _, c in classes([(r.doc_id, plain(r.text)) for r in before])}
        elif name == "decontamination":
            assert not any(hits(plain_words(r.text), items, decontam.WINDOW)[0] for r in rows if r.doc_id not in {b.doc_id for b in before if b.text == r.text})
            clean = {r.doc_id: r.text for r in before if not hits(plain_words(r.text), items, decontam.WINDOW)[0]}
            assert clean.items() <= {r.doc_id: r.text for r in rows}.items()
        elif name == "pii":
            assert not any(pii.base_spans(r.text) for r in rows) and len(rows) == len(before)
            assert all(r.n_chars == len(r.text) for r in rows if "[" in r.text and r.text != {b.doc_id: b.text for b in before}[r.doc_id])
        else:
            assert {r.doc_id for r in rows} == {b.doc_id for b in before} and all(r.decodes for r in rows)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_rows_through_all_stages(spark):
    """Nulls, empty and long texts, repeated rows and ids, ties, and columns with clashing names, stage after stage."""
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 600 and 3000").orderBy("doc_id").limit(12).collect()]
    texts = [None, "", " \n\t ", "one two", *good, good[0], good[0], (good[1] + " ") * 60, good[2] + " call +1 (619) 555-0053 or a@b.co", "日本語 😀 " * 40]
    ids = [None, 1, 1, 2, *range(10, 10 + len(good)), 10, None, 40, 41, 42]
    rows = [(i, t, None if k % 3 == 0 else "en", "s", None, "clash", 1.0, k, b"x", "h") for k, (i, t) in enumerate(zip(ids, texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, m double, fp long, body binary, h string")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before = docs.collect()
        after = out.collect()
        if k == len(corpus_pipeline.STAGES) - 1:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            break
        assert out.columns == docs.columns
        if name == "quality_rules":
            kept = quality_rules.rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()
            assert sorted(map(str, (r.doc_id for r in after))) == sorted(map(str, (r.doc_id for r in kept)))
        elif name == "simhash_near_dedup":
            found = {}
            for i, _, c in classes([(str(r.doc_id), plain(r.text)) for r in before]):
                found.setdefault(c, set()).add(i)
            assert len(after) == len(found) and sum(r.text == good[0] for r in after) == 1
        elif name == "pii":
            assert len(after) == len(before) and not any(pii.base_spans(r.text or "") for r in after)
        docs = spark.createDataFrame(after, docs.schema)


def test_repeated_rows_and_nulls_are_cleaned_alike(spark):
    """Decontamination on rows that the stages before it may keep out: nulls, equal ids, equal rows, long texts."""
    items = spark.createDataFrame([("i", "one two three four five six seven eight nine ten eleven")], "item_id string, text string")
    hit = "before it " * 30 + "one two three four five six seven eight nine ten eleven" + " and after" * 30
    rows = [(1, hit, "clash"), (1, hit, "clash"), (None, hit, None), (None, None, None), (2, "", "x"), (2, "plain words", "x"), (3, "plain words " * 20_000, "x"), (4, "one two three four five six seven eight nine ten", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = decontam.cleaned(docs, items).collect()
    want = [(i, t.replace("one two three four five six seven eight nine ten eleven", "") if t == hit else t, s) for i, t, s in rows if i != 4]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
