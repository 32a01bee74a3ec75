"""What the operators share: the word rule, table reading, and cutting a plan at a written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import stage_table

__all__ = ["FOLDS", "WORD", "clean_cut", "cut", "fresh", "held_out", "hot_join", "n_words", "row_id", "table", "words"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

FOLDS = 5

#: Rows of an Arrow batch while a table is written between steps: texts are long, and the batches of all tasks
#: of an executor lie outside its heap.
ARROW_ROWS = 1_000


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, every executor can
    read it, and a lost executor takes none of it along."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    if 0 < int(before) <= ARROW_ROWS:
        return stage_table.cut(df)
    conf.set(key, str(ARROW_ROWS))
    try:
        return stage_table.cut(df)
    finally:
        conf.set(key, before)


#: While it is true, Spark removes an execution's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def clean_cut(df: DataFrame) -> DataFrame:
    """cut(), after which the shuffle files of the table's making are gone; what ``df`` shares with others is made anew there."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        return cut(df)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)


def words(text: str | Column) -> Column:
    """Array of the text's words; null and empty texts have none. Splitting at single spaces needs no regular
    expression, so other white space becomes spaces first, and empty pieces between spaces go afterwards."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        col = F.replace(col, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(col, " "), "")


def n_words(text: str | Column) -> Column:
    """Number of words of a text, as long; null counts 0."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


#: A key is hot where it has more than this share of all rows, and at least so many; so there are at most
#: 1 / HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 1e-3, 1_024


def hot_join(many: DataFrame, few: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``many`` with ``few`` on ``key``. ``few`` has one row for each key, with the number of rows
    that ``many`` has of it. The at most 1 / HOT_SHARE rows of hot keys are broadcast, so that rows of one
    key stay spread as they are; all other keys are dealt by hash. Both sides should be written tables."""
    total = few.agg(F.sum(count)).first()[0] or 0
    bound = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = few.where(F.col(count) > bound)
    if not hot.limit(1).count():
        return many.join(few, key)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(few.where(F.col(count) <= bound), key)
    return many.join(F.broadcast(hot), key).unionByName(rest)


def row_id(*columns: str) -> Column:
    """128 bits that stand for a row's values; null differs from every value."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("|", *marked)))


def held_out(doc_id: str | Column) -> Column:
    """Whether a row's label is never learned from: crc32 of its doc_id as text, modulo FOLDS, is 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % FOLDS == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
