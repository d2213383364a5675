import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from meterfold.llm import decontamination, jaccard_join, language_id, line_dedup
from meterfold.llm.common import table
from tests import compare
from tests.llm import samples
from tests.llm.test_tokens import check_packed

SMALL = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmarks", "packing"]


@data
def test_line_dedup_equals_sql(spark):
    got = compare.spark_rows(entry.queries()["op4_line_dedup"](spark, SMALL))
    assert compare.difference(got, compare.duck_rows(compare.connect(SMALL), entry.oracle_sql()["op4_line_dedup"])) is None


@data
def test_stages_do_what_their_operators_say(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, seen[-1], SMALL).write.parquet(path)
        seen.append(spark.read.parquet(path))
    assert all(set(df.columns) == set(docs.columns) for df in seen[:-1])
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in seen]
    predicted = {r["doc_id"]: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert ids[1] == {d for d, r in predicted.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    assert ids[2] == ids[1]
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup(seen[1]).collect()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in seen[2].collect()} == {d: (t, len(t)) for d, t in left.items()}
    assert ids[3] == {r["doc_id"] for r in jaccard_join.classes(seen[2]).collect() if r["doc_id"] == r["component_id"]}
    bad = {r["doc_id"] for r in decontamination.leaks(seen[3], table(spark, SMALL, "benchmark")).collect()}
    assert ids[4] == ids[3] - bad and bad
    texts = {r["doc_id"]: [r["text"]] for r in seen[4].collect()}
    rows = seen[5].collect()
    assert check_packed(rows, texts, window=1024) < 0.01
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted((r["doc_id"], r["start"], r["length"]) for r in rows)


@data
def test_odd_rows_and_an_empty_table_pass_through_all_stages(spark):
    for df in (samples.frame(spark), samples.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, df, SMALL)
            assert after.columns == df.columns
            df = spark.createDataFrame(after.collect(), after.schema)
        assert (df.count() == 0) == (corpus_pipeline.STAGES[-1][1](spark, df, SMALL).count() == 0)
