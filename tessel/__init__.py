"""tessel: dependency and secret analytics, and corpus preparation, on PySpark."""
