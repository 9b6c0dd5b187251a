"""draftwell: line-work data quality, repair and corpus preparation on Spark."""
