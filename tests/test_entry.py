"""The registry works without the corpus operators, and passes on import errors of theirs that are not their absence."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"


def copy(at):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{HERE}/{name}"):
            shutil.copy(f"{HERE}/{name}", at)
    shutil.copytree(f"{HERE}/leadloom", f"{at}/leadloom", ignore=shutil.ignore_patterns("__pycache__", "llm"))


def run(at):
    return subprocess.run([sys.executable, "-c", SAY], cwd=at, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": os.pathsep.join(p for p in sys.path if p and os.path.abspath(p) != HERE)})


@pytest.mark.parametrize("leftover", [False, True])
@pytest.mark.parametrize("pipeline", [False, True])
def test_without_corpus_operators(tmp_path, leftover, pipeline):
    copy(tmp_path)
    if leftover:  # an empty folder, as a deletion may leave it
        (tmp_path / "leadloom/llm").mkdir()
    if not pipeline and (tmp_path / "corpus_pipeline.py").exists():
        (tmp_path / "corpus_pipeline.py").unlink()
    out = run(tmp_path)
    assert out.returncode == 0, out.stderr
    queries, oracles, corpus = map(int, out.stdout.split())
    assert queries >= oracles > 100 and corpus == 0


def test_other_import_errors_are_raised(tmp_path):
    copy(tmp_path)
    (tmp_path / "leadloom/llm").mkdir()
    (tmp_path / "leadloom/llm/__init__.py").write_text("")
    (tmp_path / "leadloom/llm/queries.py").write_text("import no_such_module\n")
    out = run(tmp_path)
    assert out.returncode != 0 and "no_such_module" in out.stderr


def test_no_constant_of_the_queries_is_assigned_twice():
    """A query reads its constants when it runs: a second assignment further down would give it other ones than its SQL."""
    import ast
    import pathlib

    import leadloom.plans

    for path in pathlib.Path(leadloom.plans.__file__).parent.glob("*.py"):
        names = [t.id for x in ast.parse(path.read_text()).body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name)]
        assert sorted(names) == sorted(set(names)), path.name
