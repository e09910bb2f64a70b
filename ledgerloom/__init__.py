"""ledgerloom: transaction histories as token sequences, on Spark.

Every public operator takes DataFrames and returns a DataFrame; no operator
collects data to the driver except the bounded per-round candidate lists of
the BPE trainer and fitted ML models.
"""

__version__ = "0.1.0"
