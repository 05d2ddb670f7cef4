"""Multi-round data reduction on graphs and point sets, written for Spark.

Every public function takes DataFrames and returns DataFrames on the caller's
session.  See the sub-packages: ``operators`` (trees, clusters, coresets,
k-means, run-log analytics), ``sources`` (readers, writers, generators),
``functions`` (column helpers), ``plans`` (round schedules, lineage cuts).
"""

__version__ = "0.1.0"
