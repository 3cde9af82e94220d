"""Planning operators: DataFrames in, DataFrames out."""
