"""The driver's contract: names, SQL for each core query, and both with and without the optional part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from strandloom import queries

ROOT = Path(entry.__file__).parent


def test_every_core_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.count() == 5702 and "kmer_offset" in df.columns


def test_imports_without_the_optional_part(tmp_path):
    import shutil

    shutil.copytree(ROOT / "strandloom", tmp_path / "strandloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and done.stdout.split() == [str(len(queries.QUERIES))] * 2, done.stderr
