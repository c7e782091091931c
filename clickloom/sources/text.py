"""Text and JSON inputs and outputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clickloom.functions.rules import EPOCH, js_trim

# Words used when no word file exists.
DEFAULT_WORDS = ["exampleword1", "exampleword2", "exampleword3"]

# The web server's default "combined" line.
ACCESS_LINE = (
    r'\A(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+)(?: [^"]*)?" (\d{3}) (\d+|-)'
    r' "((?:[^"\\]|\\.)*)" "((?:[^"\\]|\\.)*)"\s*\z'
)
_SEPARATOR = "\x1f"
ACCESS_TIME = "dd/MMM/yyyy:HH:mm:ss Z"


def clean_words(lines: DataFrame) -> DataFrame:
    """Filter words of a `value` column of lines: trimmed, blank ones dropped."""
    return lines.select(js_trim(F.col("value")).alias("word")).filter("word <> ''")


def read_filter_words(
    spark: SparkSession, path: str, default: list[str] | None = None
) -> DataFrame:
    """Filter words of a text file, the sample words when there is no file."""
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        words = DEFAULT_WORDS if default is None else default
        lines = spark.createDataFrame([(w,) for w in words], "value string")
    return clean_words(lines)


def parse_requests(raw: DataFrame, schema: StructType, column: str = "body") -> DataFrame:
    """Typed fields of JSON bodies; a malformed body is kept in `malformed`."""
    corrupt = StructField("malformed", StringType(), True)
    parsed = F.from_json(
        column,
        StructType([*schema.fields, corrupt]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"},
    )
    others = [c for c in raw.columns if c != column]
    return raw.select(*others, parsed.alias("_body")).select(*others, "_body.*")


def _dash_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit("-"))


def parse_access_log(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Typed rows of access-log lines, and the lines that do not fit or whose time is none.

    One pass of the pattern cuts a line into its parts. The separator cannot be
    part of a line: the server writes control characters in escaped form.
    """
    text = F.col(column)
    groups = _SEPARATOR.join(f"${i}" for i in (1, 3, 4, 5, 6, 7, 8, 9))
    parts = F.split(F.regexp_replace(text, ACCESS_LINE, groups), _SEPARATOR, -1)
    cut = lines.withColumn("_parts", F.when(~text.contains(_SEPARATOR), parts))
    part = lambda k: F.get("_parts", F.lit(k))
    stamp = F.try_to_timestamp(part(1), F.lit(ACCESS_TIME))
    fits = F.coalesce((F.size("_parts") == 8) & stamp.isNotNull(), F.lit(False))
    rows = cut.filter(fits).select(
        part(0).alias("ip"),
        (F.expr(EPOCH) + F.make_dt_interval(secs=F.unix_seconds(stamp))).alias("ts"),
        part(2).alias("method"),
        part(3).alias("path"),
        part(4).cast("int").alias("status"),
        F.coalesce(part(5).try_cast("long"), F.lit(0)).alias("bytes"),
        _dash_to_null(part(6)).alias("referer"),
        _dash_to_null(part(7)).alias("useragent"),
    )
    return rows, cut.filter(~fits).drop("_parts")


def to_frames(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON text; NULL fields are written as null."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias(column))


def message_frames(messages: DataFrame) -> DataFrame:
    """Chat frames (frame_id, json) of sent messages; the message keeps its JSON type.

    An object in which a key stands twice is passed on as it stands.
    """
    sent = F.try_variant_get(F.try_parse_json("frame"), "$.message", "variant")
    text = F.from_json("frame", "message string")["message"]
    body = F.struct("username", sent.alias("message")).alias("message")
    frame = F.to_json(F.struct(F.lit("message").alias("type"), body))
    name = F.to_json(F.struct("username"))
    raw = F.concat(
        F.lit('{"type":"message","message":'),
        F.substring(name, F.lit(1), F.char_length(name) - 1),
        F.lit(',"message":'),
        text,
        F.lit("}}"),
    )
    as_it_stands = sent.isNull() & text.rlike(r"\A[\[{]")
    return messages.select("frame_id", F.when(as_it_stands, raw).otherwise(frame).alias("json"))


def user_list_frames(changes: DataFrame) -> DataFrame:
    """User-list frames (ts, conn_id, kind, json) of presence changes."""
    frame = F.struct(F.lit("userList").alias("type"), "users")
    return changes.select("ts", "conn_id", "kind", F.to_json(frame).alias("json"))
