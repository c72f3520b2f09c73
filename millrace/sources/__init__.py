"""Readers and writers: messages, the lake, the key-value table."""
