"""Data operators for trustworthy inventories built from many imperfect sources, on Spark."""
