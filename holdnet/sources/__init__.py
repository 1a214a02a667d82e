"""Table inputs (parquet readers and the canonical fixture tables) and sinks."""
