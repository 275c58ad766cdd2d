"""A PySpark-native engine for numerical and experimental data held as DataFrames."""

__version__ = "0.1.0"
