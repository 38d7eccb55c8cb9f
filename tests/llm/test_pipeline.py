"""The pipeline's stages on one small table, each checked on its own input."""

import random

import corpus_pipeline
import pytest

from mailgrain.llm import decontamination, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    passage = " ".join(f"word{chr(97 + i)}" for i in range(20))
    prose = [" ".join(f"{a}{b}" for a in "klmnop" for b in ("ara", "ist", x)) for x in ("one", "two", "san", "ver", "lin", "tur", "pal", "gon")]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(prose)]
    rows += [(10, prose[0], "en", "s", 1), (10, prose[0], "en", "s", 1), (11, None, "en", "s", 0), (12, "12 34", None, "s", 5), (13, prose[1].replace("kara", "kara kara", 1) + " " + passage, "en", "s", 9),
             (14, prose[2] + " password = abcdef123 end", None, None, None), (None, prose[3] + " " + prose[4], "en", "s", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r.doc_id: r for r in docs.collect()})
    assert set(seen[0]) == {*range(8), 10, 13, 14, None}
    assert set(seen[1]) == {*range(8), 13, 14, None} and docs.count() == len(seen[3])
    assert set(seen[2]) == {*range(8), 14, None}
    assert set(seen[3]) == set(seen[2])
    assert seen[3][14].text.endswith(" [secret] end") and seen[3][14].n_chars == len(seen[3][14].text)
    assert all(seen[3][i].text == seen[2][i].text and seen[3][i].n_chars == seen[2][i].n_chars for i in seen[3] if i != 14)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [*range(8), 14, None]))
    assert len({r.sequence_id for r in rows}) == 1


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_that_share_an_id_or_have_none(spark):
    rnd = random.Random(3)
    prose = [" ".join(f"{rnd.choice('klmnop')}{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(9)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    near = prose[0] + " tail"
    assert simhash_distance(prose[0], near) <= 3
    rows = [(None, t, "en", "s", 1) for t in prose[:4]] + [(None, prose[0], "en", "s", 1), (5, prose[4], "en", "s", 1), (5, prose[5], "en", "s", 1), (5, None, "en", "s", 0),
            (6, near, "en", "s", 1), (7, prose[6], "en", "s", 1), (6, prose[6], "en", "s", 1), (6, prose[7], "en", "s", 1), (6, prose[7], "en", "s", 1)]
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, shape).repartition(3), "")
    want = [(None, t) for t in prose[1:4]] + [(5, prose[4]), (5, prose[5]), (5, None), (6, near), (6, prose[6]), (6, prose[7])]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))

    rows = [(i, t, "en", "s", 1) for i in (None, 5) for t in prose[:4]]
    items = spark.createDataFrame([(1, " ".join(prose[0].split()[:20]))], "item_id long, text string")
    clean = decontamination.decontaminated(spark.createDataFrame(rows, shape), items)
    assert sorted(map(str, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(str((i, t)) for i in (None, 5) for t in prose[1:4])


def simhash_distance(a, b):
    return (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
