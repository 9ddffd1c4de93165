"""strata: Spark-native table preparation, segmentation and typed analytical queries.

Every row-level step is a DataFrame transformation; only per-column statistics,
small k curves and model parameters reach the driver.
"""

__version__ = "0.1.0"
