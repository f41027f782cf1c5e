"""Spark-native analytics over public job-listing feeds.

Every public function takes DataFrames and returns DataFrames.  Nothing here collects
rows to the driver; results are plans that Catalyst optimises with the caller's query.
"""

__version__ = "0.1.0"
