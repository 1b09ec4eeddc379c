"""Structured Streaming forms of the event log. Windows, watermarks and exactly-once
deduplication go beyond the reference's in-memory bus and are extensions."""
