"""Table schemas, sources and sinks."""
