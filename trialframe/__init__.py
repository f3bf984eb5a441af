"""trialframe: target-trial cohort framing, event features and treatment-effect
estimation as Spark DataFrame operators.

Sub-packages
  sources    readers / writers (parquet, csv, jdbc, logs, memoised tables)
  functions  column helpers (time arithmetic, deterministic hashing, text)
  operators  relational building blocks, cohort, events, features, effects,
             matching, diagnostics, reports
  plans      mappings of concrete tables onto the concepts + registered queries
  llm        training-data operators over text, pages and vectors
"""

__version__ = "0.1.0"
