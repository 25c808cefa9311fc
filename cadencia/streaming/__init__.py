"""Structured Streaming: raw events in, deduplicated, parsed and folded into each athlete's form."""
