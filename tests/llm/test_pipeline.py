import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean, toxic, copied, near-copied, contaminated and odd documents."""
    rng = random.Random(11)
    plain = lambda n: " ".join(rng.choice(["river", "stone", "cloud", "field", "house", "tree", "light"]) + rng.choice(["s", "ed", "ing", "ly"]) + str(rng.randint(0, 99)) for _ in range(n))
    item = plain(30)
    rows, labels = [], []
    for i in range(240):
        text = plain(60)
        if i % 3 == 0:
            words = text.split()
            for _ in range(6):
                words[rng.randrange(60)] = rng.choice(["vileness", "vilely", "vilest"])
            text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 3 == 0)))
    clean = rows[1][1]
    rows += [(300, clean, "en", "s", 1), (301, clean + " tail", None, None, None), (302, f"{plain(40)} {item} {plain(5)}", "en", "s", 1), (303, None, None, None, None), (304, "", "", "", 0), (None, plain(30), "en", "s", 1), (1, clean, "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {None if r["doc_id"] is None else r["doc_id"] for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    toxic, unique, clean = seen
    wrong = sum(i in toxic for i in range(0, 240, 3)) + sum(i not in toxic for i in range(240) if i % 3)
    assert wrong <= 4 and {None, 302, 303, 304} <= set(toxic) <= kept
    assert unique.count(1) == 1 and 300 not in unique and 301 not in unique and {None, 302, 303, 304} <= set(unique)
    assert set(unique) - set(clean) == {302}


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids_crc32"} <= set(found.columns)
    rows = found.collect()
    assert {302, 300, 301}.isdisjoint({r["doc_id"] for r in rows}) and {None, 1, 303, 304} <= {r["doc_id"] for r in rows}
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_empty_documents(spark, sf_dir, tmp_path):
    for name in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_dealt_operator_is_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
