"""A Spark-first analytics engine: classical machine learning as DataFrame plans."""
