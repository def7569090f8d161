"""Feed ingestion, snapshot tables and dimension preparation."""
