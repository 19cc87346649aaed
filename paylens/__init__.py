"""paylens: card-payment analytics expressed as Spark DataFrame plans.

Layout:
  sources/    readers (parquet/csv/json/text), the events->transactions adapter,
              payload parsers, seed dimensions, stream record decoding
  sinks/      partitioned file writers, snapshot upserts, metric/audit tables
  functions/  Column-expression library shared by batch and streaming
  operators/  dashboards, rolling features, joins, scoring, quality, drift,
              governance, guardrails, retrieval, global ranking, ML
  plans/      the named-query registry (Spark builder + DuckDB oracle SQL)
  streaming/  Structured Streaming consumer and stateful velocity
"""

__version__ = "0.1.0"
