"""The pipeline, stage by stage, against plain versions."""

import random
from collections import defaultdict

from conftest import prose
from test_documents import shingles, stats

import corpus_pipeline as pipeline


def write(spark, d):
    rng = random.Random(9)
    good = [prose(rng, 150) for _ in range(60)]
    texts = dict(enumerate(good))
    texts |= {100: good[0], 101: "12 34", 102: None, 103: "a b", 104: "spam " * 60, 105: good[2].replace(" ", "  ", 1), 106: good[5] + "\n" + prose(rng, 40)}
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return texts


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    texts = write(spark, d)
    docs, left = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        left.append({r.doc_id: r.text for r in docs.collect()})
    assert not {101, 102} & set(left[0])
    want = {i for i in left[0] if stats(texts[i])[0] >= 10 and 100 * stats(texts[i])[4] <= 20 * stats(texts[i])[0]}
    assert set(left[1]) == want and {103, 104}.isdisjoint(want)
    assert set(left[2]) == want - {100, 105} and left[2][106] == texts[106].split("\n")[1] and all(left[2][i] == texts[i] for i in range(60))
    sets = defaultdict(set, {i: set(shingles(t)) for i, t in left[2].items()})
    assert all(5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b]) for a in left[3] for b in left[3] if a < b)
    assert set(left[3]) == set(left[2])
    packed = pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == set(left[3])
    whole = pipeline.run(spark, d).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_empty_tables(spark, no_tables):
    assert pipeline.run(spark, no_tables).count() == 0
