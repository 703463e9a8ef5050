"""reqscope: HTTP request-log analytics and anomaly scoring on Spark.

Sub-packages:
  sources    read raw request dumps and the derived request views, sinks
  functions  column expressions (request structure, descriptive features)
  operators  DataFrame operators (quality, splits, metrics, BPE, models, ...)
  plans      the registered queries and their SQL oracles, the end-to-end run
  streaming  the stateless operators applied to a streaming DataFrame
"""

__version__ = "0.1.0"
