"""The analysis operators: DataFrame in, DataFrame out, nothing executed."""
