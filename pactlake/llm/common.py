"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of digits, letters a-z and anything outside ASCII, on lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


_PARTS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Bytes up to which a side of a join is sent to all executors.
MOST_BROADCAST = 16 << 20


#: Temporary folders of local applications.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or where it is unset a temporary one (local runs only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        found = _local[app]
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing will read again."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Words of a text (runs of WORD, A-Z folded); null has none.

    One pass folds letters and turns all that parts words into blanks; splitting at blanks is much quicker than WORD.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + _PARTS, string.ascii_lowercase + " " * len(_PARTS))
    return F.array_remove(F.split(plain, " "), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row: rows share it only if id and text agree, and then have the same result. Null-safe."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text, F.length(text)).cast("string"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that later projections do not evaluate them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_broadcast(df: DataFrame, row_bytes: int, most: int = MOST_BROADCAST) -> DataFrame:
    """Broadcast df (rows of at most about row_bytes) if it fits into `most` bytes; else leave the join to shuffle."""
    rows = max(1, most // row_bytes)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
