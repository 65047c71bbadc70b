"""Event logs and progress lines as streams."""
