"""Sources of siftlode."""
