"""Feed mappings, file and message sources and sinks, model tables."""
