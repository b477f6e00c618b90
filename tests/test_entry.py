import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("gridloom.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "flagship_events_zscore" in q and set(o) <= set(q), sorted(o)
assert not any(n.startswith("op") or n == "pipeline" for n in q)
"""


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "asset", "step", "factor"] and df.count() == 450


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_stands_without_the_llm_folder():
    assert subprocess.run([sys.executable, "-c", BLOCKED], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__)).returncode == 0


def test_a_broken_operator_is_an_error(tmp_path):
    """Only absent folders are passed over; what is there must import."""
    (tmp_path / "gridloom" / "llm").mkdir(parents=True)
    shutil.copy(entry.__file__, tmp_path)
    for name, text in (("gridloom/__init__.py", ""), ("gridloom/queries.py", "QUERIES, ORACLE_SQL = {'x': 1}, {}"), ("corpus_pipeline.py", "")):
        (tmp_path / name).write_text(text)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()))"], capture_output=True, text=True, cwd=tmp_path)
    assert run().stdout == "['x']\n"  # an empty folder is an absent one
    (tmp_path / "gridloom/llm/__init__.py").write_text("")
    (tmp_path / "gridloom/llm/queries.py").write_text("import no_such_module")
    assert run().returncode != 0
