"""The engine's tables on the shared folder, as the operators of this subpackage use them."""

from tidemark.scratch import Scratch, shared_folder

__all__ = ["Scratch", "shared_folder"]
