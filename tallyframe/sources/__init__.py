from .tables import Snapshot, read_table  # noqa: F401
