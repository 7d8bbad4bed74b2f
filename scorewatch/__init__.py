"""scorewatch: Spark-native score-quality and drift monitoring.

Every public function takes and returns Spark DataFrames. Row work runs on
the executors; only small fitted state (column roles, scaling constants,
bin edges) is collected to the driver.

Sub-packages
------------
sources    readers, derived fixture views, exact sampling, generators, sinks
functions  column-expression builders (bands, bins, p-value series)
operators  splits, roles, features, fitted transforms, rank statistics,
           metrics, drift, stability, ensemble weighting, Spark ML jobs
plans      composed reports and the query catalogue used by the driver
streaming  Structured Streaming counterparts of the batch monitors
"""

__version__ = "0.1.0"
