"""Moving the files that a plan deletes into a quarantine folder.

Names are allotted by a DataFrame; the moves themselves run on the driver, one file at a time, as they
change a file system that the plan's paths belong to. The first names of a folder are those of its own
files; a file whose name is taken gets ``stem_1.ext``, ``stem_2.ext`` and so on, the least that is free.
"""

from __future__ import annotations

import os
import re
import shutil
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from .plan import with_keepers, without_keeper


def numbered(paths: DataFrame) -> DataFrame:
    """(path, name): base names with an ordinal for all but the first of equal ones, for an empty folder
    where no plain name looks like a numbered one."""
    rows = paths.select("path", scalars.base_name(F.col("path")).alias("name"))
    k = F.row_number().over(W.partitionBy("name").orderBy("path")) - 1
    return rows.select("path", F.when(k == 0, F.col("name")).otherwise(F.concat(scalars.stem(F.col("name")), F.lit("_"), k.cast("string"), scalars.extension(F.col("name")))).alias("name"))


def free_name(name: str, taken: set[str]) -> str:
    """``name``, or with the least number from 1 that makes it free."""
    if name not in taken:
        return name
    m = re.fullmatch(r"(.+)(\.[^.]*)", name, re.S)
    stem, ending = m.groups() if m else (name, "")
    k = 1
    while f"{stem}_{k}{ending}" in taken:
        k += 1
    return f"{stem}_{k}{ending}"


def apply_plan(plan: DataFrame, folder: str = "./quarantine", dry_run: bool = True, hardlink: bool = False, allow_no_keeper: bool = False, stop_on_error: bool = True) -> Iterator[dict]:
    """Move every file to delete; yields {path, target, keeper, status} as it goes, status being
    ``planned``, ``moved`` or an error. Rows come from the cluster a partition at a time. By default
    nothing is moved, and a plan that keeps nothing of some cluster is refused."""
    if hardlink:
        warnings.warn("hardlink makes no links: files are only moved", stacklevel=2)
    if not allow_no_keeper and (lost := without_keeper(plan).first()):
        raise ValueError(f"cluster {lost[0]} would lose all its files")
    taken = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    if not dry_run:
        os.makedirs(folder, exist_ok=True)
    for row in with_keepers(plan).orderBy("cluster_id", "path").toLocalIterator():
        name = free_name(os.path.basename(row["path"]), taken)
        target, status = os.path.join(folder, name), "planned"
        if not dry_run:
            try:
                shutil.move(row["path"], target)
                status = "moved"
            except OSError as e:
                if stop_on_error:
                    raise
                status = f"error: {e}"
        if status in ("planned", "moved"):
            taken.add(name)
        yield {"path": row["path"], "target": target, "keeper": row["keeper"], "status": status}
