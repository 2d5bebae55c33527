"""The core works without the optional folder, and says what it misses on a cluster."""

import os
import shutil
import subprocess
import sys

import pytest

from palimpso.functions import lineage

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def copy(tmp_path, *, keep_llm):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/palimpso", tmp_path / "palimpso", ignore=shutil.ignore_patterns("__pycache__", *([] if keep_llm else ["llm"])))
    return tmp_path


def ask(folder, code):
    return subprocess.run([sys.executable, "-c", f"import __spark_entry__ as e\n{code}"], cwd=folder, capture_output=True, text=True, timeout=120)


def test_entry_without_the_optional_folder(tmp_path):
    done = ask(copy(tmp_path, keep_llm=False), "q, o = e.queries(), e.oracle_sql()\nassert set(o) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1') for n in q)\nprint(len(q))")
    assert done.returncode == 0 and int(done.stdout) >= 61, done.stderr
    os.remove(tmp_path / "corpus_pipeline.py") if (tmp_path / "corpus_pipeline.py").exists() else None
    assert ask(tmp_path, "e.queries()").returncode == 0


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/palimpso/llm"), reason="the optional folder is not here")
def test_errors_in_the_optional_folder_are_not_hidden(tmp_path):
    folder = copy(tmp_path, keep_llm=True)
    (folder / "palimpso/llm/catalog.py").write_text("import no_such_module_anywhere\n")
    done = ask(folder, "e.queries()")
    assert done.returncode != 0 and "no_such_module_anywhere" in done.stderr


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session())
