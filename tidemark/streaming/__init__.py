"""Live feeds and ordered replication on Structured Streaming."""
