"""Fleet telemetry analytics as plain Spark jobs.

Every operator takes DataFrames and returns a DataFrame; thresholds, machines,
dates and zones are arguments.  Nothing runs until the caller acts on a result,
except where a docstring says so (clustering, size checks of broadcast sides).
"""

from fleetspark.session import build_session

__all__ = ["build_session"]
