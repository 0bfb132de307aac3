"""Readers and writers of events, rules and logs."""
