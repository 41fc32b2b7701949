"""Reading, selecting and writing event tables."""
