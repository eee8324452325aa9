"""The pipelines over streams of new files."""

from .stream import stream_lines, write_lines

__all__ = ["stream_lines", "write_lines"]
