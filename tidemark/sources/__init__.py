"""Sources and sinks: database reads, Bronze, marks, published tables."""
