"""Sources and sinks: table loading, CSV ingest with salvage, generated fixtures, run tables."""
