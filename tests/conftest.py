import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from fleetspark import build_session  # noqa: E402
from fleetspark.schema import TELEMETRY, TELEMETRY_TYPES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "fleetspark-tests",
        master="local[4]",
        extra={
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Telemetry rows from dictionaries; columns not given are NULL."""
    import datetime as dt

    def build(rows, extra=""):
        schema = ", ".join(f"{c} {TELEMETRY_TYPES[c]}" for c in TELEMETRY)
        names = list(TELEMETRY)
        if extra:
            schema += ", " + extra
            names += [part.split()[0] for part in extra.split(",")]
        full = []
        for row in rows:
            row = dict(row)
            if isinstance(row.get("date_time"), str):
                row["date_time"] = dt.datetime.fromisoformat(row["date_time"])
            full.append(tuple(row.get(n) for n in names))
        return spark.createDataFrame(full, schema)

    return build
