"""tideline: loan-panel, prepayment and factor-pricing analytics on Spark DataFrames."""

__version__ = "0.1.0"
