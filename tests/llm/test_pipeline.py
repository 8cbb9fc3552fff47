"""The pipeline's stages on small tables: decisions, columns, empty input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from vellum.llm import common

FINE = "the of and to in is that was for on with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()
ANDERE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, component_id int, score double, node string, row int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(7)
    say = lambda w, n: " ".join(r.choice(w) for _ in range(n))
    shared = say(FINE, 90)
    docs, labels = [], []
    for i in range(300):
        words, lang = (FINE, "en") if i % 3 else (ANDERE, "de")
        t = say(words, r.randint(30, 90))
        bad = i % 6 == 1
        if bad:
            t = f"{t} grobbler {say(words, 5)} grobbler"
        docs.append((i, t, lang))
        labels.append((i, 1, int(bad)))
    docs += [(300 + k, docs[k][1], "en") for k in range(2, 60, 6)]
    docs += [(400 + k, f"{say(FINE, 30)} {shared} {say(FINE, 30)}", "en") for k in range(5)]
    docs += [(500, None, None), (501, "", "en"), (502, "1234 !!! 99", "en"), (None, say(FINE, 40), "en"), docs[3]]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, lang, "s", len(t or ""), 1, 0.5, "n", 7) for i, t, lang in docs]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    columns = docs.columns
    seen = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.saved(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns, name
        seen.append({(r["doc_id"], r["text"]) for r in docs.collect()})
    language, clean, single, cut = seen
    ids = lambda rows: {i for i, _ in rows}
    assert not ids(language) & {500, 501, 502} and set(range(300)) <= ids(language)
    toxic = {i for i in range(300) if i % 6 == 1}
    assert not ids(clean) & toxic and ids(language) - ids(clean) == toxic
    assert ids(clean) - ids(single) == {300 + k for k in range(2, 60, 6)} and None in ids(single)
    assert ids(cut) == ids(single)
    before, after = dict(single), dict(cut)
    for k in range(400, 405):
        assert len(after[k].encode()) < len(before[k].encode()) - 200
    assert all(before[i] == after[i] for i in before if i is not None and i < 300)
    assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert docs.count() == len(cut)


def test_run(spark, folder):
    got = pipeline.run(spark, folder).toPandas()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)
    whole = got.dropna(subset=["doc_id"]).groupby("doc_id").agg({"length": "sum", "doc_tokens": "first"})
    assert (whole.length == whole.doc_tokens).all()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
