"""tiltkit: option trading volume by investor class, on Spark DataFrames.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
runs no action, except where a docstring says so (size checks before a
broadcast, explicit checkpoints).
"""

__version__ = "0.1.0"
