"""Training-data operators. Self-contained: only the standard scientific stack and PySpark."""
