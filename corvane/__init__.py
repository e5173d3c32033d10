"""corvane: content integrity, linking and text-safety checks on PySpark DataFrames."""
