"""meristem: a catalogue of analytics operators expressed as Spark DataFrames and Columns."""
