"""Approximate string search on Spark.

``nearspark.operators`` holds the DataFrame operators, ``functions`` the column
functions and alphabets, ``sources`` readers and writers, ``plans`` options
and plan rewrites, ``streaming`` the streaming form, and ``kernel`` the NumPy
code that runs inside Arrow batches.
"""

from nearspark.plans.options import SearchOptions

__version__ = "0.1.0"
__all__ = ["SearchOptions"]
