"""Knowledge-base analytics on PySpark DataFrames."""
