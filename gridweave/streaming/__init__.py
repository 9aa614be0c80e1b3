"""Images that arrive in micro-batches."""

from gridweave.streaming.batches import each_image

__all__ = ["each_image"]
