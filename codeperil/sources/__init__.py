"""Readers: coverage reports, diffs, snapshots, source files, configuration."""
