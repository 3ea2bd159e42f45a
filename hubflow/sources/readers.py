"""Readers and writers of the freight tables, with names and types put right."""

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ascii_key(name: str) -> str:
    """A header without accents, case and outer space, as a key to compare by."""
    plain = unicodedata.normalize("NFKD", name.replace("ı", "i")).encode("ascii", "ignore").decode()
    return " ".join(plain.casefold().split())


def rename_standard(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed by ascii_key; those not named stay. A name without its column raises."""
    have = {ascii_key(c): c for c in df.columns}
    missing = [k for k in names if ascii_key(k) not in have]
    if missing:
        raise ValueError(f"columns {missing} are not among {df.columns}")
    return df.withColumnsRenamed({have[ascii_key(k)]: v for k, v in names.items()})


def clean(df: DataFrame, text: list[str], strict: list[str] = (), lenient: list[str] = ()) -> DataFrame:
    """Texts trimmed; numbers cast, strict ones with an error where they aren't numbers, lenient ones as 0."""
    out = {c: F.trim(c) for c in text} | {c: F.col(c).cast("double") for c in strict} | {c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in lenient}
    return df.withColumns(out)


def split_lane(label: str, lenient: bool = False):
    """source and dest of a label, parted by the first →, -> or =>; without one an error, or lenient also by a hyphen and else dest unknown."""
    parts = F.split(F.trim(label), r"\s*(?:→|->|=>" + (r"|-" if lenient else "") + r")\s*", 2)
    dest = F.when(F.size(parts) == 2, F.trim(parts[1])).otherwise("unknown" if lenient else F.raise_error(F.concat(F.lit("no lane: "), F.col(label))))
    return F.trim(parts[0]), dest


#: What the columns of a demand log may be called, best first.
CANDIDATES = {"source": ("source", "origin", "cikis tm", "cikis"), "dest": ("dest", "destination", "varis tm", "varis"), "date": ("date", "tarih"), "volume": ("volume", "desi", "toplam desi"), "slot": ("slot", "talep saati", "saat")}


def standard_log(df: DataFrame) -> DataFrame:
    """The five columns of a demand log, found by name, else by place."""
    have = {ascii_key(c): c for c in df.columns}
    found = {}
    for i, (name, names) in enumerate(CANDIDATES.items()):
        found[name] = next((have[n] for n in names if n in have), df.columns[i])
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


def read_demand_history(spark: SparkSession, path: str) -> DataFrame:
    """A demand log of CSV or Parquet files; workbooks are converted to one of them outside."""
    df = spark.read.csv(path, header=True) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    d = standard_log(df)
    return d.select(F.trim("source").alias("source"), F.trim("dest").alias("dest"), F.to_date("date").alias("date"), F.col("volume").cast("double").alias("volume"), "slot")


def require(df: DataFrame, columns: list[str], exactly: bool = False) -> DataFrame:
    """df, if it has the columns (and no others)."""
    missing = [c for c in columns if c not in df.columns]
    if missing or exactly and len(df.columns) != len(columns):
        raise ValueError(f"expected columns {columns}, found {df.columns}")
    return df


def plan_of_demands(df: DataFrame, columns: list[str], demand: str = "demand_id") -> DataFrame:
    """A plan's rows that belong to a demand, if it has the columns: a blank or null demand marks an empty trip."""
    return require(df, columns).where(F.trim(demand) != "")


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), format: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).format(format).option("header", True).save(path)
