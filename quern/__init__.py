"""quern: analytics queries and data-processing operators written Spark-first."""
