"""Table sources and sinks: driver-table adapters and canonical-table I/O."""
