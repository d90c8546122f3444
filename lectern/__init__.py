"""lectern: document retrieval and question answering as Spark DataFrame jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames
(or Columns); nothing is collected to the driver except bounded, size-checked
query blocks used by the exact vector search.
"""

from lectern.session import build_session, checkpoint_dir, read_table

__all__ = ["build_session", "checkpoint_dir", "read_table"]
