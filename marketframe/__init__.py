"""marketframe: daily-bar analytics on Spark DataFrames.

Bars -> technical indicators -> training sets -> models -> dated
predictions -> drift reports, for all tickers in one plan.
"""

__version__ = "0.1.0"
