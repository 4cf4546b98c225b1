import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from tesserae.session import local_session
spark = local_session(2, 2)
for name in {names!r}:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The driver knows the package by its own path only, and stands elsewhere."""
    names = ["chk_packed_parts", "md_clean_markup", "chk_slugs"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), names=names)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [x.split()[0] for x in done.stdout.splitlines() if x.split()[0] in names] == names
