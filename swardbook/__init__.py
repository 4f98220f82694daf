"""Spark-native ledger engine for service businesses.

Every operator takes DataFrames and returns DataFrames; nothing in here opens
a database connection or keeps state between calls.
"""
