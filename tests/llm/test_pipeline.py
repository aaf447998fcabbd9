"""The pipeline against the stages worked through by plain Python, and on edge cases."""

import re

import pytest

import corpus_pipeline

from annolith.llm import langid, mixing, queries

from .helpers import EDGE, documents
from .test_operators import brute_contamination, brute_lines, brute_near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    """Half of the smallest tables, so that all pairs of lines can be compared."""
    at = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 90 and length(text) < 3000")
    docs.coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline_brute_force(spark, small):
    docs = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    scorer = langid.Scorer(langid.fit_language_model(spark.read.parquet(f"{small}/documents.parquet")))

    def told(text):
        import numpy as np

        s = scorer.text(text or "")
        return s is not None and 1 / np.exp((s - s.max()) * 0.5).sum() >= 0.35

    docs = {d: r for d, r in docs.items() if told(r["text"])}
    gone = brute_lines([(d, r["text"]) for d, r in docs.items()])
    for d, r in list(docs.items()):
        keep = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if (d, i) not in gone)
        if keep != r["text"] and not keep.strip():
            del docs[d]
        else:
            docs[d] = r | {"text": keep, "n_chars": len(keep)}
    groups, _ = brute_near_copies([(d, r["text"]) for d, r in docs.items()])
    docs = {d: r for d, r in docs.items() if groups[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    held = {d for d, _ in brute_contamination([(d, r["text"]) for d, r in docs.items()], items)}
    docs = {d: r for d, r in docs.items() if d not in held}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) <= set(docs) and all(got[d].text == docs[d]["text"] and got[d].n_chars == docs[d]["n_chars"] for d in got)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for d, r in docs.items()}
    sources = {}
    for d, r in docs.items():
        sources.setdefault(r["source"], []).append(d)
    for s, ds in sources.items():
        mine = [got[d] for d in ds if d in got]
        assert all(m.source_size == sum(size[d] for d in ds) and m.size == size[m.doc_id] for m in mine)
        if mine:
            assert abs(sum(m.taken for m in mine) - mine[0].target) <= 1, s
    assert all(r.taken > 0 for r in got.values()) and held and gone


@pytest.mark.parametrize("at", range(5))
def test_stages_on_edges(spark, sf, at):
    name, f = corpus_pipeline.STAGES[at]
    for rows in (EDGE, []):
        docs = documents(spark, rows)
        out = f(spark, docs, sf)
        assert out.columns[:5] == COLUMNS and (at == 4 or out.columns == COLUMNS)
        n = out.count()
        assert n <= len(rows) and (n > 0) == bool(rows), name


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(queries.ORACLES) <= names


def test_op6_twin(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.OP6_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op6_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)[list(want.columns)]
    assert got.astype(float).round(6).equals(want.astype(float).round(6))
    assert mixing.WORD == r"[^\x20\x09-\x0D]+"
