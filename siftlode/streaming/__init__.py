"""Streaming of siftlode."""
