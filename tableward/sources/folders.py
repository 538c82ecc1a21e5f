"""Where temporary tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tableward.session import work_folder


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the work folder."""
    return f"{work_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
