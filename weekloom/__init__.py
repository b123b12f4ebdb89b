"""Weekly surveillance analytics on Spark: DataFrame in, DataFrame out."""
