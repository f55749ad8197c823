import ast
from pathlib import Path

import pytest

import corpus_pipeline
from siftpool.llm.registry import queries

ROOT = Path(__file__).resolve().parents[2]
SMALL = "/root/testdata/sf0.001"
NAMES = {1: "substring", 2: "chat", 3: "license", 4: "toxicity", 5: "token", 6: "retrieval", 7: "fingerprints", 8: "decontamination", 9: "language", 10: "near", 11: "ball", 12: "quality", 13: "repaired"}


def test_every_operator_has_a_query():
    names = list(queries())
    assert all(any(q.startswith(f"op{n}_{x}") for q in names) for n, x in NAMES.items()) and len(names) == len(NAMES) == 13


def test_nothing_else_imports_the_operators():
    for p in (ROOT / "siftpool").rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n.split(".") for n in names), p


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n, schema = docs.count(), docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        assert out.schema == schema
        assert out.join(docs.select("doc_id"), "doc_id", "left_anti").isEmpty()
        kept = out.count()
        assert 0.7 * n < kept <= n
        docs, n = out, kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == n


def test_run_handles_odd_tables(spark, tmp_path):
    rows = [(1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (3, "some words of a text", None, None, 5, None), (3, "some words of a text", None, None, 5, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 3]
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
