"""Points from raw payloads, stored files and ledgers."""

from __future__ import annotations

from decimal import Decimal
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions.vectors import mean_vector

PAYLOAD_SCHEMA = (
    "id string, vector array<float>, named_vectors map<string,array<float>>, payload struct<source:string,source_file:string,source_collection:string,source_id:string,"
    "layer:string,tone:string,run_id:string,text:string,summary:string,canonical_statement:string,report:string,verdict:string,"
    "claims:array<string>,concepts:array<string>,echoes:array<string>,questions:array<string>,tags:array<string>>"
)
#: As points are stored: the unnamed vector in a dense field, or in the data field of older stores.
STORED_SCHEMA = PAYLOAD_SCHEMA + ", dense array<float>, data array<float>"
GREATEST_ID = Decimal(2**64 - 1)


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def cut(c: Column, n: int) -> Column:
    """At most n characters, the last three of a longer text being dots. Characters, not bytes."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def _list(c: Column, most: int) -> Column:
    return F.slice(F.filter(c, lambda x: F.coalesce(x != "", F.lit(False))), 1, most)


def _labelled(prefix: str, c: Column, most: int) -> Column:
    items = _list(c, most)
    return F.when(F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(items, ", ")))


def fragment(p: str = "payload") -> Column:
    """The text that stands for a point: statement or summary, claims, concepts, echoes, questions, tags; else report and verdict; else text."""
    f = lambda n: F.col(f"{p}.{n}")
    joined = lambda n, most: F.when(F.size(_list(f(n), most)) > 0, F.array_join(_list(f(n), most), " | "))
    own = F.concat_ws(
        " | ", F.coalesce(_given(f("canonical_statement")), _given(f("summary"))), joined("claims", 3), _labelled("Concepts: ", f("concepts"), 6),
        _labelled("Echoes: ", f("echoes"), 4), joined("questions", 2), _labelled("Tags: ", f("tags"), 6),
    )
    report = F.concat_ws(" | ", cut(_given(f("report")), 300), F.concat(F.lit("Verdict: "), cut(_given(f("verdict")), 150)))
    return cut(F.coalesce(_given(own), _given(report), cut(_given(f("text")), 500), F.lit("N/A")), 500)


def numeric_id(c: str | Column = "id") -> Column:
    """A number up to 2**64 - 1 stays; of a UUID the first 16 hex digits as an unsigned number; anything else is 0."""
    c = F.col(c) if isinstance(c, str) else c
    hex_ = F.substring(F.replace(c, F.lit("-"), F.lit("")), 1, 16)
    number = F.when(c.rlike(r"^\d{1,20}$"), c.try_cast("decimal(20,0)"))
    return F.when(number <= F.lit(GREATEST_ID), number).when(hex_.rlike("^[0-9a-fA-F]{16}$"), F.conv(hex_, 16, 10).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))


def unnamed_vector(*columns: str) -> Column:
    """The first of the columns that has numbers: the dense field before the one of older stores."""
    return F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in columns])


def chosen_vector(name: str = "", combine: bool = False) -> Column:
    """The unnamed vector; else the mean of the named ones or the one named; else the first by name."""
    named = F.map_entries("named_vectors")
    ordered = F.transform(F.sort_array(F.filter(named, lambda e: F.size(e["value"]) > 0)), lambda e: e["value"])
    plain = F.when(F.size("vector") > 0, F.col("vector"))
    first = F.try_element_at(ordered, F.lit(1))
    if combine:
        return F.coalesce(plain, mean_vector(ordered), first)
    by_name = F.try_element_at("named_vectors", F.lit(name)) if name else F.lit(None)
    return F.coalesce(plain, F.when(F.size(by_name) > 0, by_name), first) if name else F.coalesce(plain, first)


def normalise_payload(raw: DataFrame, vector_name: str = "", combine: bool = False) -> DataFrame:
    """``(id, embedding, fragment, source, layer, run_id)`` of the raw points that have a vector."""
    f = lambda n: _given(F.col(f"payload.{n}"))
    if "dense" in raw.columns:
        raw = raw.withColumn("vector", unnamed_vector("dense", "vector", "data"))
    return raw.select(
        numeric_id().alias("id"), chosen_vector(vector_name, combine).alias("embedding"), fragment().alias("fragment"),
        F.coalesce(f("source"), f("source_file"), f("source_collection"), f("source_id"), F.lit("unknown")).alias("source"),
        F.coalesce(f("layer"), f("tone"), F.lit("surface")).alias("layer"), F.coalesce(F.col("payload.run_id"), F.lit("")).alias("run_id"),
    ).where(F.col("embedding").isNotNull())


def read_payloads(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Raw points of JSON lines; strict fails on a malformed line, else it is skipped."""
    return spark.read.schema(STORED_SCHEMA).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_points(spark: SparkSession, path: str, limit: int = 0, strict: bool = True) -> DataFrame:
    """Stored points; with a limit the first by id."""
    df = spark.read.option("ignoreCorruptFiles", str(not strict).lower()).parquet(path)
    return df.orderBy("id").limit(limit) if limit else df


def host(url: str) -> str:
    """Host of an address with or without scheme and port."""
    return urlparse(url if "://" in url else f"//{url}").hostname or ""


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stamps written below ``path``; none where nothing was stamped yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "id decimal(20,0), stamped_at timestamp, run_id string")
    return spark.read.parquet(path)


def unprocessed(points: DataFrame, ledger: DataFrame, key: str = "id") -> DataFrame:
    """Points without a stamp."""
    return points.join(ledger.select(key).distinct(), key, "left_anti")


def stamp(points: DataFrame, path: str, run_id: str, key: str = "id") -> None:
    """Add the points to the ledger under ``run_id``; a repeated run replaces its own stamps."""
    rows = points.select(key).distinct().withColumn("stamped_at", F.current_timestamp()).withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
