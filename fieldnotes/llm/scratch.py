"""Tables that cut lineage, as the engine writes them."""

from fieldnotes.scratch import clear, cut, folder

__all__ = ["clear", "cut", "folder"]
