"""Streaming: apply a fitted segmentation to a stream (the reference has no stream operators;
scoring new rows with a fitted model is the one stream use that follows from it)."""
