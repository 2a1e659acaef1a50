"""rankloom: ranking data preparation, training and evaluation on PySpark.

Every operator takes and returns DataFrames (or Columns) so that Catalyst sees
the whole computation.  See README.md for the map of modules.
"""

__version__ = "0.1.0"
