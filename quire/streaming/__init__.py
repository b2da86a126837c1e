"""Streaming entry points (the batch operators' row-local parts work on streams as is)."""

from quire.streaming.replies import first_usable_replies

__all__ = ["first_usable_replies"]
