"""Table, JDBC and message sinks."""
