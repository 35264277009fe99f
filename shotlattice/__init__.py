"""Analytics over time-coded media metadata as Spark DataFrame operators."""
