"""Names of columns that an operator adds for its own use."""

from pyspark.sql import DataFrame


def hidden(frames: "DataFrame | list[DataFrame]", *names: str) -> list[str]:
    """A name for each that no column of the frames has, in any case of letters."""
    frames = frames if isinstance(frames, list) else [frames]
    taken = {c.lower() for df in frames for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def free(df: DataFrame, *names: str) -> None:
    """Raises where df has one of the names already."""
    taken = {c.lower() for c in df.columns}
    if odd := [n for n in names if n.lower() in taken]:
        raise ValueError(f"the table has a column {odd[0]}")
