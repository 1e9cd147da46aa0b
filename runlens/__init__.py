"""runlens: analytics over records of automated code-repair runs, on PySpark DataFrames."""
