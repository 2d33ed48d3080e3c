from txscreen.sources.derived import transactions_from_events
from txscreen.sources.files import (
    read_csv,
    read_csv_with_account,
    read_parquet,
    schema_profile,
    write_csv,
)
from txscreen.sources.scratch import (
    job_folder,
    keep_on_disk,
    materialize,
    new_path,
    session_settings,
    stored_result,
)

__all__ = [
    "job_folder",
    "keep_on_disk",
    "materialize",
    "new_path",
    "read_csv",
    "read_csv_with_account",
    "read_parquet",
    "schema_profile",
    "session_settings",
    "stored_result",
    "transactions_from_events",
    "write_csv",
]
