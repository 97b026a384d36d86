"""innsight: hospitality reporting marts on Spark.

Each mart is a plain ``DataFrame -> DataFrame`` function built from shared
column functions (``innsight.functions``), row operators
(``innsight.operators``) and table sources (``innsight.sources``).  The
``innsight.plans`` package composes them into the reports a property sees,
and ``innsight.plans.job.build_marts`` writes every entitled report for every
tenant in one batch.
"""

__version__ = "0.1.0"
