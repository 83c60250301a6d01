import importlib.util
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("nestwright.llm"):
        assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in entry.queries() if k.startswith("op")} and "pipeline" in entry.queries()


def test_the_rest_works_without_the_training_data_part(tmp_path):
    from nestwright.plans import queries as core

    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    for folder, left in (("nestwright", "llm"), ("tests", "llm")):
        shutil.copytree(f"{ROOT}/{folder}", tmp_path / folder, ignore=shutil.ignore_patterns(left, "__pycache__"))
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    said = run("-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))")
    assert said.returncode == 0 and said.stdout.split() == [str(len(core.QUERIES)), str(len(core.ORACLE_SQL))], said.stderr
    # The other tests are found, and those that need no session long pass.
    assert run("-m", "pytest", "tests", "--collect-only", "-q").returncode == 0
    assert run("-m", "pytest", "tests/test_sources.py", "-q", "-p", "no:cacheprovider").returncode == 0
