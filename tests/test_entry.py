"""The entry module can be read without a session, and without the llm folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print('N', len(q))"


def count(folder):
    out = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    return int(out.stdout.split("N ")[-1])


def test_without_session_and_without_llm(tmp_path):
    whole = count(ROOT)
    shutil.copytree(f"{ROOT}/tracewright", tmp_path / "tracewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    rest = count(tmp_path)
    assert rest >= 50 and whole in (rest, rest + 14)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
