"""Spark-native donor analytics and campaign-profit engine.

Library code takes DataFrames and returns DataFrames; it never collects
member-level rows to the driver.
"""

__version__ = "0.1.0"
