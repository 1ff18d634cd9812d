"""Streams: feedback folded as it arrives, runs written once however often a batch repeats."""
