"""care_analytics: clinical and claims analytics as lazy Spark plans.

Subpackages:
  sources    bundle and warehouse readers/writers, role views over driver tables
  functions  Column -> Column cleaning expressions, exact aggregates
  operators  DataFrame -> DataFrame steps: flatten, clean, group, fan-out rewrites
  plans      the analyses: ETL, cost, disparities, features, models
  streaming  incremental bundle ingestion with Structured Streaming
"""

__version__ = "0.1.0"
