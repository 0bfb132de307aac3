"""Rules over Structured Streaming."""
