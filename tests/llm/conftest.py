import os

import pytest

CLASHING = ["score", "fp", "component_id", "shard", "slot", "ids", "start", "kept", "level", "limits", "decoded"]


@pytest.fixture
def docs(spark):
    """A maker of document tables with nulls, extra columns and clashing names."""
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        for name in CLASHING:
            df = df.withColumn(name, F.lit("own"))
        return df

    return make


@pytest.fixture
def shared_folder(tmp_path):
    return os.fspath(tmp_path)
