"""A multi-tenant analytical SQL engine on Spark DataFrames."""
