"""raretab — Spark-native analytics for wide tables with a rare binary outcome.

Subpackages
-----------
sources    readers, fixture views derived from the driver tables, sinks
functions  column expressions (hash uniforms, bins, safe ratios, p-values)
operators  DataFrame operators: dedup, impute, encode, profile, prefix sums,
           statistical tests, splits, evaluation, oversampling, models
plans      end-to-end jobs: cleaning, profiling report, two-phase ensemble
"""

__version__ = "0.1.0"
