"""Copy ledger: file-catalog deduplication as Spark DataFrame operators."""
