"""Streams: change feeds, streaming views, late data, sinks."""
