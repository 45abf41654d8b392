"""Schema guards that run on the driver before any job starts."""

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """First of several accepted spellings that the frame has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(
        f"none of {', '.join(candidates)} found; columns are {', '.join(df.columns)}"
    )


def move_to_front(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Existing preferred columns first, the others in their present order."""
    front = [c for c in preferred if c in df.columns]
    return df.select(*front, *[c for c in df.columns if c not in front])


#: Columns that only serve the ingest and are not part of any split.
HELPER_COLUMNS = ("tar_file", "image_path")
