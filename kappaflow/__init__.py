"""kappaflow: grade free-text reports and measure grader agreement on Spark.

Every operator is DataFrame -> DataFrame, takes column names as arguments
and runs no action; only sinks and explicit stage writes act.
"""

__version__ = "0.1.0"
