"""Graph, search, change and ingest operators; every operator maps tables to tables."""
