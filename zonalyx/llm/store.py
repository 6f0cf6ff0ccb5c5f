"""Tables kept between stages, as everywhere in the library."""

from zonalyx.operators.store import DEFAULT_DIR, discard, keep, new_path, release, shared_dir

__all__ = ["DEFAULT_DIR", "discard", "keep", "new_path", "release", "shared_dir"]
