"""Document-processing analytics on Spark: page decisions, layout geometry, recognised-text
parsing, page-range assembly and folder ingestion as DataFrame operations."""
