from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerwork import session as settings  # noqa: E402


def session() -> SparkSession:
    builder = SparkSession.builder.master("local[8]").appName("ledgerwork-tests")
    builder = builder.config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-"))
    spark = settings.apply(builder, 8).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return session()
