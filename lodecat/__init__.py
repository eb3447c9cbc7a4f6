"""lodecat: dataset discovery and curation as Spark jobs.

Every operator takes DataFrames and returns DataFrames; every scalar function takes and
returns a Column.  Nothing here opens a network connection: sources are landed files.
"""

from lodecat.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
