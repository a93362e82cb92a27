"""Sections of odd documents: rows are documents, whatever their ids, and a document's own text is whole."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from relatrix.operators import sections as X
from relatrix.plans import registry

ODD = [
    (1, ""), (2, None), (3, "x\r"), (4, "\u00a0x\u3000"), (5, "x \u2028"), (6, "\x1fx\x1f \t"), (7, "\u3000"), (8, "one\ntwo\n"), (8, "other"), (9, "same"), (9, "same"),
    (None, "none"), (None, "nil"), (10, "x\ue000"), (11, " \x85"),
]


def test_documents_of_any_id_and_text(spark, tmp_path):
    """Rows of one id were cut as one text, rows without an id were lost, and a text's own spaces were taken off or kept other than in SQL."""
    ids, texts = zip(*ODD, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ODD), "source": ["s"] * len(ODD)}), tmp_path / "documents.parquet")
    df = registry.QUERIES["win17_sections"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    want = duck.execute(registry.ORACLES["win17_sections"])
    columns = [d[0] for d in want.description]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(want.fetchall())


def test_sections_are_cut_in_one_pass(spark):
    """Sections and their headings were two frames, joined by document: all lines were shuffled and carried along twice."""
    docs = spark.createDataFrame([(1, "II. a\ntext\n1. b\nmore\n가. c\n\nIII. d\n2. 주석\nnote\n3. e\n x ")], "doc_id long, text string")
    out = X.sections(docs, 1)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.start_line, r.end_line, r.path, r.headings, r.text) for r in out.collect())
    assert got == [(1, 2, ["II"], ["II. a"], "text"), (3, 4, ["II", "1"], ["II. a", "1. b"], "more"), (8, 9, ["III", "2"], ["III. d", "2. 주석"], "note"), (10, 11, ["III", "3"], ["III. d", "3. e"], "x")]
