"""Plans: the end-to-end segmentation flow and the registered query catalogue."""
