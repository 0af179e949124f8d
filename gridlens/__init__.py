"""gridlens — batch and streaming energy-metering analytics on Spark.

One typed ``readings`` table (see :mod:`gridlens.schema`) feeds reports,
tariff costing, dashboard summaries, training series, anomaly detection,
forecasting and a tamper audit against a ledger table.  Every operator is a
function ``DataFrame -> DataFrame``; nothing is collected to the driver.
"""

__version__ = "0.1.0"
