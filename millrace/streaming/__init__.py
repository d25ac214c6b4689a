"""Structured Streaming forms of jobs that have one."""
