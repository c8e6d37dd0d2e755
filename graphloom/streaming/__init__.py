"""Extension: incremental dirtiness over streams."""
