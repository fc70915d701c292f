"""Runnable jobs: each has a command line, a small JSON config and a function that takes a session."""
