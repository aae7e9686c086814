"""foliospark: document analytics on PySpark DataFrames."""
