"""tallyframe: a Spark-native analytics engine for ordered event logs.

Subpackages: ``sources`` (scans and sinks), ``functions`` (Column builders), ``operators``
(DataFrame -> DataFrame operators), ``plans`` (registered queries and their SQL) and
``streaming`` (Structured Streaming forms of the per-key folds).
"""
