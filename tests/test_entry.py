import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_the_optional_part(tmp_path):
    """Without the corpus subpackage, or with an empty folder left of it, the other queries are there."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "leafwright", tmp_path / "leafwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    say = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"
    for _ in range(2):
        said = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, capture_output=True, text=True)
        queries, sql, optional = said.stdout.split()
        assert int(queries) > 50 and int(sql) > 50 and optional == "False"
        (tmp_path / "leafwright" / "llm" / "__pycache__").mkdir(parents=True, exist_ok=True)


def test_other_import_errors_are_not_hidden(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "leafwright", tmp_path / "leafwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "leafwright" / "llm").mkdir()
    (tmp_path / "leafwright" / "llm" / "entries.py").write_text("import no_such_module_at_all\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode and "no_such_module_at_all" in said.stderr
