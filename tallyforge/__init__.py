"""Contest analytics on Spark: DataFrame-to-DataFrame operators over draft contests."""
