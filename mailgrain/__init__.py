"""Mailing-list and patch analytics on Spark: DataFrame in, DataFrame out."""
