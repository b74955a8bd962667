"""prepkit — Spark-native data preparation and multivariate statistics.

Sub-packages:

* ``sources``   — CSV/Parquet/workbook scans, keyed yearly batches (S1–S7)
* ``sinks``     — CSV writers and durable stage hand-off (K1–K3)
* ``functions`` — column expressions: quoting, NA tokens, time, rounding (P-family)
* ``operators`` — set ops, profiling, statistics, features, imputation (U, A, O, F)
* ``plans``     — the reference's workflows (W1–W8) and the registered queries
"""

__version__ = "0.1.0"
