"""The driver contract without the removable folders."""

import subprocess
import sys

HIDDEN = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "quillspark.llm" or name.startswith("quillspark.llm.") or name in {gone}:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name if name in {gone} else "quillspark.llm")
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""


def test_queries_without_the_removable_folders():
    for gone in ("()", "('corpus_pipeline',)"):
        subprocess.run([sys.executable, "-c", HIDDEN.replace("{gone}", gone)], check=True, timeout=120)
