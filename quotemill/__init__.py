"""Price statistics over large quote tables, expressed as Spark DataFrame operators.

Sub-packages
------------
functions   column expressions and small distributed primitives (quantiles, hashing, regressions)
operators   DataFrame -> DataFrame building blocks, one module per subject
sources     extracts, payload mappers, ledger and publication sinks
plans       composed jobs (cleaning run, index run) and views over star-schema tables
streaming   Structured Streaming jobs
catalog     named queries with the SQL each one is checked against
"""
