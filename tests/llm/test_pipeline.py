"""The pipeline against its stages worked out row by row, and the package without the text operators."""

import subprocess
import sys
from itertools import combinations
from pathlib import Path

import corpus_pipeline
from terratile.llm import decontaminate, near_copies, quality_crf, quality_rules
from terratile.llm.queries import _read

SF = "/root/testdata/sf0.001"


def test_rows_of_the_pipeline(spark):
    docs, labels, items = (_read(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality_rules.quality_report(docs).collect() if r.kept}
    left = docs.where(docs.doc_id.isin(sorted(good)))
    field = quality_crf.fit_on(left, labels)
    order = sorted(good)
    kept = [i for i, s in zip(order, field.score([rows[i].text for i in order]), strict=True) if s >= 0.3]
    sets = {i: near_copies.shingles(rows[i].text) for i in kept}
    part = {i: i for i in kept}
    for i, j in combinations(kept, 2):
        if part[i] != part[j] and (sets[i] == sets[j] or near_copies.jaccard(sets[i], sets[j]) >= 0.8):
            low, high = sorted((part[i], part[j]))
            part = {k: low if p == high else p for k, p in part.items()}
    first = {i for i in kept if part[i] == i}
    hit = {r.doc_id for r in decontaminate.contained_items(docs, items).collect()}
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: rows[i].text for i in first - hit} and got


def test_stages_return_the_columns_of_documents(spark):
    docs = _read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0


def test_entry_without_the_text_operators(tmp_path):
    root = Path(corpus_pipeline.__file__).parent
    for name in ("terratile", "__spark_entry__.py"):
        (tmp_path / name).mkdir() if name == "terratile" else (tmp_path / name).write_text((root / name).read_text())
    for p in (root / "terratile").iterdir():
        if p.name != "llm":
            (tmp_path / "terratile" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'f1_vector_top_k' in q and not any(k.startswith('op') for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
