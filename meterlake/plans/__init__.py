"""Jobs: the stored tables, the ingest pass, repricing and the reports."""
