"""quire: instruction-data preparation on Spark DataFrames.

Every public operator takes and returns DataFrames (or Columns) and is
expressed with built-in Spark SQL functions so Catalyst can prune, push
down and code-generate the work.  Random choices are keyed md5 draws, so a
result never depends on partitioning or on task retries.
"""

__version__ = "0.1.0"
