"""loomgrid: analytics over entity x feature matrices and labelled pairs, on PySpark DataFrames."""

__version__ = "0.1.0"
