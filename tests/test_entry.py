import __spark_entry__ as entry_module


def test_flagship(spark):
    assert entry_module.entry(spark).count() == 100


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_sql_is_available_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_entry_works_without_the_training_data_package():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("vacloom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
found = e.queries()
assert "search_signal_page" in found and "pipeline" not in found and not any(n.startswith("op") and n[2:3].isdigit() for n in found)
assert set(e.oracle_sql()) <= set(found)
"""
    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_nothing_outside_imports_the_training_data_package():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "vacloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(?m)^\s*(?:from|import)\b.*\bllm\b", path.read_text()), path
