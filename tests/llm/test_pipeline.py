"""The pipeline's stages on a small table, each against what its operator promises."""

from collections import Counter

import corpus_pipeline
from lookalike.llm import common
from tests.llm.cases import DOCS, documents
from tests.llm.test_text_ops import brute_components, brute_repeats, toxic_rows, words


def test_stages(spark, tmp_path):
    made, marks = toxic_rows(120)
    rows = [r for r in documents() if r[0] is not None and r[0] != 5] + [(i + 1000, t, lang, s, len(t)) for i, t, lang, s, _ in made]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i + 1000, q, t) for i, q, t in marks], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(path := f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(path)
        seen.append([tuple(r) for r in docs.collect()])
        if name != "pieces":
            assert docs.columns == [c.split(" ")[0] for c in DOCS.split(", ")]
    clean, unique, cut, mixed, ids = seen
    assert len(clean) < len(rows) and {r[0] for r in rows} - {r[0] for r in clean} <= {1000 + i for i, _, t in marks if t}
    sets, groups = brute_components(clean)
    want = [clean[min((i for i in g), key=lambda i: clean[i][0])][0] for g in groups if sets[g[0]]] + [r[0] for r, s in zip(clean, sets, strict=True) if not s]
    assert Counter(r[0] for r in unique) == Counter(want)
    assert Counter((r[0], r[4]) for r in brute_repeats(unique) if not (r[2] and r[2] == r[1])) == Counter((r[0], " ".join(words(r[1]))) for r in cut)
    assert Counter(r[0] for r in mixed) == Counter(r[0] for r in ids) and len(mixed) >= sum(bool(words(r[1])) for r in cut) / 3
    assert all(r[3] == len(r[4]) > 0 for r in ids)
    again = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert Counter((r[0], tuple(r[4])) for r in again) == Counter((r[0], tuple(r[4])) for r in ids)
    assert common.FOLDS == 5


def test_run_keeps_the_training_order(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(12 + i % 9)), "en", f"s{i % 3}", 1) for i in range(60)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = corpus_pipeline.mixing.mix(spark.createDataFrame(rows, DOCS), position_column="position").collect()
    assert Counter((r["doc_id"], r["position"]) for r in got) == Counter((r["doc_id"], r["position"]) for r in want)
    assert len({r["position"] for r in got}) > 50
