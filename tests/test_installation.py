"""Tasks run the library's code on machines where it is not installed."""

import os
import subprocess
import sys
from pathlib import Path

from conftest import ROOT, add_file, auction_rows, person_rows

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from gavelstream import schemas
from gavelstream.plans import continuous
from gavelstream.session import build_session, streaming_session
from gavelstream.sources import read_stream
from gavelstream.streaming.runner import run_to_table

spark = streaming_session(build_session("elsewhere", "local[2]", {{
    "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.checkpoint.dir": "checkpoints"}}))
found = continuous.local_items_latest(read_stream(spark, "auctions", schemas.AUCTION),
                                      read_stream(spark, "persons", schemas.PERSON))
print([r.auction_id for r in run_to_table(found, "elsewhere").collect()])
"""


def test_workers_do_not_import_the_library(tmp_path):
    for name, frame in (("auctions", auction_rows((1, 7, 10, 5, 9))),
                        ("persons", person_rows((7, "Ann", "Salem", "OR", 5)))):
        (tmp_path / name).mkdir()
        add_file(tmp_path / name, 0, frame)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(Path(ROOT)))], cwd=tmp_path,
                         env=environment, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("[1]"), run.stderr[-2000:]


def test_entry_survives_a_missing_library():
    """Without what the training-data operators need, all other queries are there."""
    code = ("import sys; sys.modules['zstandard'] = None; sys.modules['xxhash'] = None; import __spark_entry__ as e; "
            "assert e.llm is None and 'q5_hot_items' in e.queries() and e.queries().keys() == e.oracle_sql().keys()")
    import subprocess
    import sys
    from pathlib import Path
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
