"""Functions of siftlode."""
