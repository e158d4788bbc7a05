"""Relational operators, versioned tables and training-data operators on PySpark."""
