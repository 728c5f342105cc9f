"""Flow-detection analytics as Spark DataFrame operators.

Every public operator takes DataFrames and column names and returns DataFrames.
See README.md for the module map.
"""

__version__ = "0.1.0"
