"""snapmill: snapshot performance analytics on PySpark DataFrames."""
