"""Data-mining operators written as PySpark DataFrame, ML and Structured Streaming jobs."""
