import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from convolake.session import LOCAL_DEFAULTS, ensure_checkpoint_dir
    b = SparkSession.builder.master("local[*]").appName("convolake-tests") \
        .config("spark.sql.shuffle.partitions", "8")
    for k, v in LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


def rows(df, *cols):
    """Collect selected columns as a list of tuples, sorted."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
