"""Where reports find their files: one sub-folder or file per method."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_FILE = r"pulverizacao_(\d+)"


def line_sources(folder: str) -> dict[str, list[str]]:
    """Line files of each method by its name: the numbered files of a sub-folder (all its files, if none is numbered), or a file of that name.

    Names in order; of a folder and a file with one name the first in the listing counts.
    """
    found: dict[str, list[str]] = {}
    for entry in sorted(Path(folder).iterdir()):
        if entry.is_dir():
            files = sorted(map(str, entry.glob("pulverizacao_*.geojson"))) or sorted(map(str, entry.glob("*.geojson")))
            if files:
                found.setdefault(entry.name, files)
        elif entry.is_file() and entry.suffix.lower() == ".geojson":
            found.setdefault(entry.stem, [str(entry)])
    return dict(sorted(found.items()))


def polygon_sources(folder: str) -> dict[str, list[str]]:
    """The polygon file of each method: files of the folder, of its sub-folder `polygons` if there is one, or of sub-folders named after methods."""
    top = Path(folder, "polygons") if Path(folder, "polygons").is_dir() else Path(folder)
    found = {p.stem: [str(p)] for p in sorted(top.glob("*.geojson"))}
    for p in sorted(top.glob("*/*.geojson")):
        found.setdefault(p.parent.name, [str(p)])
    return dict(sorted(found.items()))


def default_field_id(path: Column) -> Column:
    """The number of a numbered line file, null for other names."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.nullif(F.regexp_extract(stem, f"^{LINE_FILE}$", 1), F.lit("")).cast("long")


def comma_paths(values: list[str]) -> list[str]:
    """Paths given one by one or separated by commas; empty ones are left out."""
    return [part.strip() for v in values for part in v.split(",") if part.strip()]


def file_number(path: str) -> int | None:
    found = re.fullmatch(LINE_FILE, os.path.splitext(os.path.basename(path))[0])
    return int(found[1]) if found else None
