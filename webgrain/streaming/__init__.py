"""Structured Streaming forms of the stateful operators. Watermarks are an addition: the batch forms have no event time."""
