import os
import sys
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from gavelstream import schemas  # noqa: E402
from gavelstream.session import build_session, streaming_session  # noqa: E402
from gavelstream.sources import read_stream  # noqa: E402

START = pd.Timestamp("2024-01-01", tz="UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def streams(spark):
    return streaming_session(spark)


def at(seconds):
    """Event time ``seconds`` after the start of the test's clock."""
    return START + pd.Timedelta(microseconds=round(seconds * 1e6))


def millis(seconds):
    return int(at(seconds).value // 1_000_000)


def _frame(rows, schema):
    return pd.DataFrame(rows, columns=schema.names)


def bid_rows(*rows):
    """Rows of (auction, bidder, price, seconds)."""
    return _frame([(a, b, p, at(s)) for a, b, p, s in rows], schemas.BID)


def auction_rows(*rows):
    """Rows of (id, seller, category, reserve, seconds)."""
    return _frame([(i, s, c, r, at(t)) for i, s, c, r, t in rows], schemas.AUCTION)


def person_rows(*rows):
    """Rows of (id, name, city, state, seconds)."""
    return _frame([(i, n, c, s, at(t)) for i, n, c, s, t in rows], schemas.PERSON)


def schema_of(frame):
    return next(s for s in (schemas.BID, schemas.AUCTION, schemas.PERSON)
                if s.names == list(frame.columns))


@pytest.fixture
def table(spark):
    return lambda frame: spark.createDataFrame(frame, schema_of(frame))


@pytest.fixture
def stream(streams, tmp_path):
    """A stream that takes in the given frames one micro-batch each."""
    made = []

    def build(*frames):
        folder = tmp_path / f"input{len(made)}"
        folder.mkdir()
        made.append(folder)
        for position, frame in enumerate(frames):
            add_file(folder, position, frame)
        return read_stream(streams, str(folder), schema_of(frames[0]), max_files_per_trigger=1)

    build.folders = made
    return build


def add_file(folder, position, frame):
    path = folder / f"{position:04d}.parquet"
    pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), path, coerce_timestamps="us")
    os.utime(path, (1_700_000_000 + position, 1_700_000_000 + position))


def rows(df):
    return sorted(map(tuple, df.collect()))
