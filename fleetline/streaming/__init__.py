"""Streams of trip updates and pings; the same folds run on batches."""
