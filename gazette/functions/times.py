"""Points in time as literals without a time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(moment: datetime) -> Column:
    """A literal that no session's time zone moves."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
