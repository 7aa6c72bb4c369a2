"""meshwright: graph analytics and data-processing operators on Spark DataFrames."""

__version__ = "0.1.0"
