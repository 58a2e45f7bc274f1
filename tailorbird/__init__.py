"""Evidence extraction and purchase decisions over tables of captured listings, on Spark."""
