"""Structured Streaming form of the incremental request copy.

The reference has no streaming operator; its only incremental work is the
resumable copy of request records (``plans.ingest``).  ``incremental``
offers the same as a file-source stream with a checkpoint, for request
tables that arrive as files.
"""

from mountwait.streaming.incremental import copy_new_files

__all__ = ["copy_new_files"]
