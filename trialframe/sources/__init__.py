"""Sources and sinks: parquet / csv / jdbc readers, table export, logs, memoisation."""
from trialframe.sources.io import *  # noqa: F401,F403
