"""The driver's contract."""

import subprocess
import sys


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "rank", "word", "score"]


def test_nothing_else_imports_the_llm_subpackage(tmp_path):
    """Without the subpackage the rest still imports and registers its queries."""
    code = "import sys\nclass No:\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('lexaudit.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
