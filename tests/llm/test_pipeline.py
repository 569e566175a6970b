"""The pipeline on planted documents, each stage against a plain version on its own input."""

import random

import corpus_pipeline as P
from notewright.llm.personal import Selector, find, redact
from notewright.llm.toxicity import toxicity
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_records import brute as contained
from tests.llm.test_texts import toxic_docs


def test_stages(spark, tmp_path):
    r = random.Random(6)
    texts, labels = toxic_docs(420)
    passage = " ".join(f"q{i}" for i in range(40))
    for i in range(0, 420, 21):
        texts[i] += " " + passage
    texts += [texts[i] for i in range(0, 60, 7)] + [texts[i] + " end" for i in range(60, 120, 7)] + ["call +1 (202) 555-0143 or a@b.org " + " ".join(r.choice("abcdef") * 3 for _ in range(30)), None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(0, passage), (1, "never there at all in any of these documents")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, sf, inputs = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path), {}
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
    for n, (name, stage) in enumerate(P.STAGES):
        inputs[name] = {x.doc_id: x for x in docs.collect()}
        out = stage(spark, docs, sf)
        assert n == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
    final = docs.collect()

    start = inputs["toxicity"]
    predicted = {x.doc_id: x.predicted for x in toxicity(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    clean = inputs["ngram_jaccard_join"]
    assert set(clean) == {i for i in start if not predicted[i]} and len(clean) < len(start)
    ids = sorted(clean)
    kept = {d for d, _, c in groups([clean[i].text for i in ids], ids, 5, 8, 10) if d == c}
    assert set(inputs["benchmark_decontamination"]) == kept and len(kept) < len(clean)
    bad = {d for d, *_ in contained([(i, x.text) for i, x in inputs["benchmark_decontamination"].items()], items)}
    assert set(inputs["pii"]) == kept - bad and bad
    selector = Selector()
    for i, x in inputs["best_fit_packing"].items():
        before = inputs["pii"][i].text
        expected = None if before is None else redact(before, find(before, selector)[1])
        assert x.text == expected and x.n_chars == (None if expected is None else len(expected))
    assert any("[PHONE]" in (x.text or "") and "[EMAIL]" in x.text for x in inputs["best_fit_packing"].values())
    assert {x.doc_id for x in final} == set(inputs["best_fit_packing"])
    assert sorted(x.length for x in P.run(spark, sf).collect()) == sorted(x.length for x in final)


def test_rows_without_an_id_and_repeated_ids_are_judged(spark, tmp_path):
    passage = " ".join(f"q{i}" for i in range(40))
    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near = one.replace("a59", "z")
    rows = [(None, one), (None, one), (None, near), (7, one), (5, near), (1, two), (1, two), (1, three), (None, three), (None, "lone words here and there"), (None, passage), (2, f"x {passage}"), (1, f"y {passage} y"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def found(frame):
        return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)

    clean = P.decontaminate(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and found(clean) == sorted((r for r in rows if passage not in (r[1] or "")), key=str)
    kept = P.one_of_each_group(spark, clean, str(tmp_path))
    assert kept.columns == docs.columns
    assert found(kept) == sorted([(5, near), (1, two), (1, three), (None, "lone words here and there"), (3, None), (4, "")], key=str)


def test_columns_that_clash_and_repeated_rows(spark, tmp_path):
    """Input columns of the names that stages use inside come out as they were; of repeated rows the smallest stays."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key int, row_number string, Fate_Key double, least_row boolean"
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "en", "b", 9, 77, "x", 1.5, True), (1, words, "en", "a", 9, 78, "y", 2.5, False), (1, words, "en", "a", 9, 78, "y", 2.5, False), (2, words + " end", "en", "s", 9, 79, "z", 3.5, None), (None, None, None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None)] * 3 + [(3, "another text altogether", "en", "s", 3, 80, "v", 0.5, True), (3, None, "en", "s", 0, 81, "w", 0.0, True)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    spark.createDataFrame([(0, words)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = P.one_of_each_group(spark, docs, str(tmp_path))
    assert kept.dtypes == docs.dtypes
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[4], rows[8], rows[9]], key=repr)
    clean = P.decontaminate(spark, docs, str(tmp_path))
    assert clean.dtypes == docs.dtypes and sorted(map(tuple, clean.collect()), key=repr) == sorted(rows[4:], key=repr)
    assert P.redact_personal_data(spark, docs, str(tmp_path)).dtypes == docs.dtypes


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
