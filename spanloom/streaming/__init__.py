"""Streams: FASTA files that arrive or grow in a folder (see sources.ranges)."""

from spanloom.sources.fasta import stream

__all__ = ["stream"]
