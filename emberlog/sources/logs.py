"""Sources and sinks of log tables: raw text, structured CSV, canonical Parquet, labels, JSON records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class LogFormat:
    name: str
    log_format: str
    masks: tuple[str, ...]
    canonical: Callable[[DataFrame], DataFrame]
    depth: int = 4
    similarity: float = 0.5


def canonical_blocks(rows: DataFrame) -> DataFrame:
    """Second-resolution lines that name blocks; a line may name several."""
    return rows.select(
        S.compact_timestamp(F.col("Date"), F.col("Time")).alias("timestamp"), F.col("EventId").alias("event_id"), F.col("EventTemplate").alias("template"),
        F.col("Level").alias("level"), F.col("Component").alias("component"), F.col("Content").alias("content"), S.keys_in(F.col("Content")).alias("block_ids"),
    )


def canonical_nodes(rows: DataFrame, dropped: Observation | None = None) -> DataFrame:
    """Microsecond lines with an alert tag, which any label but "-" is, a missing one too; lines without a time are dropped, and counted where an observation is given."""
    out = rows.select(
        S.micro_timestamp(F.col("Time")).alias("timestamp"), F.col("EventId").alias("event_id"), F.col("EventTemplate").alias("template"),
        (~F.col("Label").eqNullSafe("-")).cast("int").alias("label"), F.col("Node").alias("node"), F.col("Component").alias("component"), F.col("Level").alias("level"), F.col("Content").alias("content"),
    )
    if dropped is not None:
        out = out.observe(dropped, F.count_if(F.col("timestamp").isNull()).alias("dropped"))
    return out.where("timestamp IS NOT NULL")


#: The formats' heads.
FORMATS = {
    "HDFS": LogFormat("HDFS", "<Date> <Time> <Pid> <Level> <Component>: <Content>", S.BLOCK_MASKS, canonical_blocks),
    "BGL": LogFormat("BGL", "<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>", S.NODE_MASKS, canonical_nodes),
}


def log_format(name: str) -> LogFormat:
    if name not in FORMATS:
        raise NotImplementedError(f"no canonical form of {name}")
    return FORMATS[name]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


#: Mark of a line that fits, and what stands between its fields.
FITS, BETWEEN = "\x1e", "\x1f"


def parse_lines(lines: DataFrame, form: LogFormat, column: str = "line") -> DataFrame:
    """Adds a column for each field of the format's head; lines of another form are left out.

    The pattern runs once for a line: it puts marks between the fields, at which they are split.
    """
    pattern, names = S.header_pattern(form.log_format)
    marked = F.regexp_replace(column, pattern + r"[\r\n\u0085\u2028\u2029]*", FITS + BETWEEN.join(f"${k + 1}" for k in range(len(names))))
    slow = F.array(F.concat(F.lit(FITS), F.regexp_extract(column, pattern, 1)), *[F.regexp_extract(column, pattern, k + 1) for k in range(1, len(names))])
    fields = F.when(~F.col(column).rlike(f"[{FITS}{BETWEEN}]"), F.split(marked, BETWEEN)).when(F.col(column).rlike(pattern), slow)
    held = "fields"
    while held in lines.columns or held in names:
        held += "_"
    # a generator's result isn't computed again where it is used
    out = lines.withColumn(held, F.explode(F.filter(F.array(fields), lambda f: F.get(f, F.lit(0)).startswith(FITS))))
    values = {n: F.get(held, F.lit(k)) for k, n in enumerate(names)}
    return out.withColumns(values | {names[0]: F.substring(values[names[0]], 2, 1 << 30)}).drop(held)


def read_structured(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a head, every column a string, so that no leading zero is lost."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def read_canonical_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Canonical events in CSV; an empty text field is an empty text, not NULL."""
    df = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c, kind in df.dtypes if kind == "string"})


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """block_id and label: Normal is 0, Anomaly 1, anything else NULL."""
    raw = spark.read.schema("BlockId string, Label string").csv(path, header=True)
    return raw.select(F.col("BlockId").alias("block_id"), F.when(F.col("Label") == "Normal", 0).when(F.col("Label") == "Anomaly", 1).alias("label"))


def write_events(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet keeps arrays; CSV holds them joined by spaces."""
    if form == "csv":
        df = df.withColumns({c: F.concat_ws(" ", c) for c, kind in df.dtypes if kind.startswith("array")})
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        df.write.mode("overwrite").parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records as write_records() leaves them."""
    return spark.read.schema(schema).json(path)


def parsed_table(spark: SparkSession, path: str, name: str, out: str) -> dict[str, int]:
    """A raw file to its canonical table with mined templates, written as Parquet; the numbers of lines read, parsed, and kept."""
    from ..operators.scratch import written
    from ..operators.templates import mine_templates

    form = log_format(name)
    raw = read_lines(spark, path)
    rows = written(parse_lines(raw, form).withColumn("line_no", F.monotonically_increasing_id()), "parsed")
    mined = mine_templates(rows, "line_no", form.masks, form.depth, form.similarity, "Content")
    write_events(form.canonical(mined.withColumnsRenamed({"event_id": "EventId", "template": "EventTemplate"})), out)
    return {"lines": raw.count(), "parsed": rows.count(), "kept": spark.read.parquet(out).count()}


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
