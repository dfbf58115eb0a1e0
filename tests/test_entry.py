"""The entry points, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["ord", "chrom", "locus_begin", "locus_end", "outliers"] and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_alone(tmp_path):
    for name in ("__spark_entry__.py", "tandemlake"):
        whole = os.path.join(ROOT, name)
        if os.path.isdir(whole):
            shutil.copytree(whole, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(whole, tmp_path)
    code = "import __spark_entry__ as e; print(sorted(q for q in e.queries() if q.startswith('op') or q == 'pipeline'), 'outlier_zscore' in e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.strip() == "[] True", out.stderr


def test_library_does_not_know_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "tandemlake")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "tandemlake.llm" not in f.read() and ".llm" not in n
