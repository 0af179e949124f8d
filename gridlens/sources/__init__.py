"""Sources: table loading, the fixture views over the driver's tables, ingest."""
