import subprocess
import sys

import __spark_entry__


def test_other_queries_stand_where_the_training_data_package_cannot_be_imported(monkeypatch, recwarn):
    from strata.plans import catalog  # noqa: F401
    from strata.plans.registry import ORACLES, QUERIES

    monkeypatch.setitem(sys.modules, "strata.llm.catalog", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    if "strata.llm" in sys.modules:
        monkeypatch.delattr(sys.modules["strata.llm"], "catalog", raising=False)
    assert __spark_entry__.queries() == QUERIES and __spark_entry__.oracle_sql() == ORACLES
    assert not [n for n in QUERIES if n.startswith("op") or n == "pipeline"] and set(ORACLES) <= set(QUERIES)


def test_the_shipped_archive_imports_by_itself(tmp_path):
    from strata.session import package_archive

    path = package_archive(str(tmp_path))
    code = "import sys; sys.path[:] = [p for p in sys.path if 'repo' not in p]; sys.path.insert(0, sys.argv[1]); import strata.operators.ward as w; print(w.__file__)"
    out = subprocess.run([sys.executable, "-c", code, path], capture_output=True, text=True, cwd=tmp_path, timeout=120)
    assert out.stdout.strip().startswith(path), out.stderr
