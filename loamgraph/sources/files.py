"""Episode sources: plain text, documents, event lists and files on disk, all as DataFrames of episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DOCUMENT_BYTES, MAX_MEDIA_BYTES = 10 * 1024 * 1024, 100 * 1024 * 1024
# Accepted extensions.
DOCUMENT_TYPES = ("txt", "json", "md", "csv")
AUDIO_TYPES = ("mp3", "wav", "ogg", "flac", "m4a", "aac", "webm", "opus")
VIDEO_TYPES = ("mp4", "mov", "avi", "mkv", "webm", "mpeg", "m4v")


def normal_hash(col: str) -> Column:
    """The 64 hex digits of a SHA-256 in lower case, whatever prefix or case it is written with; null without them."""
    return F.nullif(F.lower(F.regexp_extract(F.col(col), "([0-9A-Fa-f]{64})", 1)), F.lit(""))


def text_episodes(df: DataFrame, key: str, text: str, agent: str, at: str) -> DataFrame:
    """One episode per non-null text, with its content hash."""
    t = F.col(text)
    return df.where(t.isNotNull()).select(
        F.col(key).alias("source_id"), F.col(agent).alias("agent_id"), t.alias("content"), F.col(at).alias("created_at"),
        F.length(t).cast("bigint").alias("n_chars"), F.sha2(t, 256).alias("content_hash"),
    )


def document_episodes(df: DataFrame) -> DataFrame:
    """Documents with the extension of their format and whether their size in bytes is accepted."""
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    ext = F.when(F.col("doc_format") == "markdown", "md").when(F.col("doc_format") == "events", "json").otherwise("txt")
    return df.select("doc_id", "agent_id", "text", ext.alias("extension"), n.alias("n_bytes"), n.between(1, MAX_DOCUMENT_BYTES).alias("accepted"))


def event_episodes(events: DataFrame) -> DataFrame:
    """One episode per event; the JSON payload is kept in the content and its counter parsed."""
    return events.select(
        "event_id", F.concat(F.lit("agent_"), F.col("user_id").cast("string")).alias("agent_id"), F.concat_ws(" ", "event_type", "props").alias("content"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("ts").alias("created_at"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files under path as (path, extension, n_bytes, text, accepted); undecodable bytes become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    ok = (F.col("length") <= MAX_DOCUMENT_BYTES) & ext.isin(*DOCUMENT_TYPES)
    return raw.select("path", ext.alias("extension"), F.col("length").alias("n_bytes"), F.when(ok, F.try_validate_utf8(F.decode("content", "UTF-8"))).alias("text"), ok.alias("accepted"))


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Media files under path as (path, kind, n_bytes, accepted); their bytes are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin(*VIDEO_TYPES), "video").when(ext.isin(*AUDIO_TYPES), "audio").otherwise("other")
    return raw.select("path", kind.alias("kind"), F.col("length").alias("n_bytes"), ((kind != "other") & (F.col("length") <= MAX_MEDIA_BYTES)).alias("accepted"))


def explode_json_events(df: DataFrame, key: str, payload: str) -> DataFrame:
    """One row per element of a JSON array of objects: (key, position, event as JSON text); other payloads give none."""
    arr = F.from_json(F.col(payload), "array<string>")
    return df.select(F.col(key), F.posexplode(arr).alias("position", "event"))


def write_audit(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# Accepted media types by kind, and the largest size of an upload.
AUDIO = ["audio/mpeg", "audio/mp3", "audio/wav", "audio/x-wav", "audio/ogg", "audio/flac", "audio/mp4", "audio/webm"]
VIDEO = ["video/mp4", "video/webm", "video/quicktime", "video/x-msvideo", "video/x-matroska", "video/mpeg", "video/ogg"]
MAX_MEDIA = 100 * 1024 * 1024


def media_kind(mime: Column, size: Column) -> Column:
    """'audio', 'video', 'too large' or 'refused' for a media type, parameters and case aside, and a size in bytes; null is refused."""
    t = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    kind = F.when(t.isin(AUDIO), "audio").when(t.isin(VIDEO), "video")
    return F.when(kind.isNull(), "refused").when(F.coalesce(size, F.lit(0)) > MAX_MEDIA, "too large").otherwise(kind)


def blob_path(root: str, name: Column) -> Column:
    """The path of a media blob below root; null for names that are empty, absolute or leave the folder."""
    parts = F.split(name, "/")
    bad = name.isNull() | (F.trim(name) == "") | F.startswith(name, F.lit("/")) | name.contains("\\") | F.array_contains(parts, "..") | F.array_contains(parts, "")
    return F.when(~bad, F.concat(F.lit(root.rstrip("/") + "/"), name))
