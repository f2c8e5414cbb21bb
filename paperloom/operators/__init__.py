"""Relational operators over the document tables: DataFrame in, DataFrame out, no UDF."""
