"""tierlake: layered (bronze / silver / gold) data work with quality checks,
telemetry and incident analysis, written as plain Spark DataFrame code.

Subpackages:
  functions  column expressions (lenient parsing, value maps, labels)
  sources    CSV / table / JSON-event sources and sinks, inline lookups
  operators  dedupe, joins, quality pass, drift, rules, incident queries
  plans      the marts and the staged, observed run
  streaming  incremental landing-folder ingest on Structured Streaming
"""

__version__ = "0.1.0"
