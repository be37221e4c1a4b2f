"""deskpark: support-desk analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames to a DataFrame. Nothing is
collected to the driver; the physical plan is left to Catalyst and AQE.
"""

from deskpark.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
