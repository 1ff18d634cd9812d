"""Functions of the posting engine."""
