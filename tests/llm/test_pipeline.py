"""The corpus pipeline, stage by stage, against a plain version; and tables with odd rows and clashing columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from relatrix.llm import toxicity
from relatrix.llm.common import table

from . import brute

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
#: Names that the operators use inside.
CLASHES = ["dropped", "n_lines", "n_dropped", "kept_text", "_null", "_id", "row", "gone", "absent", "key", "shard", "bucket", "score", "toxic", "family", "version", "spans", "component_id", "kept", "n", "item_id", "places", "batch", "owner"]


def brute_stages(rows, items, score):
    """rows: (doc_id, text); score: text -> toxicity. The rows each stage keeps."""
    out = [[(d, t) for d, t in rows if score[d, t] < 0.7]]
    lines = brute.line_texts(out[-1])
    out.append([(d, None if t is None else lines[i]) for i, (d, t) in enumerate(out[-1])])
    groups = brute.near_groups([(d, t) for d, t in out[-1] if d is not None])
    out.append([(d, t) for d, t in out[-1] if d is None or groups[d][1] == d])
    bad = {d for d, _ in brute.contaminated_anywhere([(d, t) for d, t in out[-1] if d is not None], items)}
    out.append([(d, t) for d, t in out[-1] if d not in bad])
    return out


def check(spark, docs, sf_dir):
    labels, items = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.learn(toxicity.training_rows(docs, labels))
    scores = toxicity._scores(model)
    score = dict(zip(plain, scores([t for _, t in plain])[0], strict=True))
    want = brute_stages(plain, [(r.item_id, r.text) for r in items.collect()], score)
    for (name, stage), rows in zip(pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        path = pipeline.new_path(spark, "test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(rows), name
    return docs, want[-1]


def test_stages_equal_plain_versions(spark):
    docs, kept = check(spark, table(spark, SF, "documents"), SF)
    assert docs.where("n_chars <> length(text)").count() == 0
    pieces = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == {d for d, _ in kept}
    assert sum(r.length for r in pieces) == sum({(r.doc_id): r.doc_tokens for r in pieces}.values())


def test_stages_take_odd_rows_and_names(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, passage), (4, passage + " tail"), (5, f"first line here\n{passage}"), (6, "First line here \nown words of six"), (None, passage), (None, None), (7, "x " * 300_000), (8, "line twice here\nline twice here"), (8, "line twice here\nline twice here")]
    docs = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(i))
    check(spark, docs, SF)
    assert pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").count() >= len(rows)
    empty = docs.where("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name

