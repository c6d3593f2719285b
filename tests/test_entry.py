"""The entry module where the optional part, or a library of it, is missing."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("hidden", ["xxhash", "seqflip.llm", "public_tokenizers"])
def test_core_queries_without_the_optional_part(hidden):
    code = (f"import sys; sys.modules[{hidden!r}] = None\n"
            "import __spark_entry__ as e\n"
            "names = set(e.queries())\n"
            "from seqflip.plans.registry import queries\n"
            "assert names >= set(queries()) and set(e.oracle_sql()) <= names\n"
            "assert not 'pipeline' in names\n"
            + ("" if hidden == "public_tokenizers" else "assert names == set(queries())\n"))
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
