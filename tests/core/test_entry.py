"""The entry points, with and without the optional subpackage, and queries against their SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from paperloom import plans

ROOT = Path(__file__).resolve().parent.parent.parent
DATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("invoice_totals", "kv_suffixed", "doc_type_argmax", "language_rules", "grounding_check", "point_in_rect_assign", "table_rows_cluster", "dashboard_stats", "rate_window", "coerce_typed", "cosine_topk", "schema_invoice", "key_entities",
          "lockout", "doc_type_floor", "cv_skills", "image_measures", "pdf_pages", "pdf_text_lines", "svg_text_lines", "table_kinds", "layout_sidebar_label", "table_previews", "keyed_items", "path_stems",
          "iou_greedy_dedupe", "column_split_roles", "table_grid", "layout_viewer", "block_segmentation", "entry_groups", "cv_education", "schema_cv_education", "document_summary")


def test_names():
    assert set(plans.SQL) <= set(plans.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(plans.QUERIES) > 120


def test_imports_without_the_optional_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert 'invoice_totals' in e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; print(len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stderr


@pytest.mark.skipif(not DATA.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_queries_agree_with_their_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    got = __spark_entry__.queries()[name](spark, str(DATA))
    got.write.parquet(str(tmp_path / "q"))
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    c.execute(f"create table o as {__spark_entry__.oracle_sql()[name]}")
    cols = ", ".join(f'"{x}"' for x in sorted(got.columns))
    ours, theirs = f"select {cols} from '{tmp_path}/q/*.parquet'", f"select {cols} from o"
    assert sorted(got.columns) == sorted(r[0] for r in c.execute("describe o").fetchall())
    assert c.execute(f"{ours} except all {theirs}").fetchall() == c.execute(f"{theirs} except all {ours}").fetchall() == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no tables")
def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "subtotal", "tax", "total"] and df.count() > 0
