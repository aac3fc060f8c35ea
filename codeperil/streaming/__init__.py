"""Streams: there are no streaming operators. Coverage reports, diffs and results are read whole, and nothing here keeps state between reads."""
