"""shopmetrics: commerce funnel, revenue, cohort and data-quality metrics on Spark DataFrames."""

__version__ = "0.1.0"
