"""The driver's contract: entry, queries and SQL, with and without the pipeline's subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_library_works_without_the_subpackage(tmp_path):
    for name in ("ledgerfold", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "ledgerfold").mkdir()
    for part in (ROOT / "ledgerfold").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "ledgerfold" / part.name).symlink_to(part)
    code = "import sys; sys.path[:] = ['.'] + [p for p in sys.path if 'repo' not in p]; import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
