"""mediamill: a PySpark library for media-library analytics (catalogue, search, timed text, signals)."""
