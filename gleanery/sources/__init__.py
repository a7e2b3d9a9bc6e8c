"""Reading, mapping and writing records."""
