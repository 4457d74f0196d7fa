"""Document analytics on Spark: typed cells, relational operators over them, and data-quality operators."""
