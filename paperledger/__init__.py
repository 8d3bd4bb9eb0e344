"""paperledger: documents to checked, structured data, as Spark DataFrame operations."""
