"""Readers, feed normalizers and sinks."""
