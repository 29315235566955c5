"""Spark-native market-structure analytics over OHLCV bars."""
