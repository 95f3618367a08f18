import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_smoke_query(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["l_orderkey", "o_orderdate", "dist"] and df.count() == 27


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'qh03' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env=env, check=True)


def test_only_the_entry_and_the_pipeline_know_the_optional_parts():
    for folder, _, files in os.walk(os.path.join(ROOT, "vecsql")):
        for name in files:
            if name.endswith(".py") and not folder.endswith("llm"):
                assert "vecsql.llm" not in open(os.path.join(folder, name)).read()
