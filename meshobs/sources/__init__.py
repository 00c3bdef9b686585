"""Message sources, configured dimensions, and sinks."""
