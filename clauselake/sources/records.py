"""Table reads, change application and intake of pages and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauselake.functions.json_text import risk_points
from clauselake.functions.text import is_blank, trim_ws
from clauselake.operators.clauses import truncate_contracts
from clauselake.runtime import broadcast_if_small, path_exists, written

CHAT_LINE = "type string, role string, content string"
#: what the last data line of a message carries
END_MARK = "[DONE]"


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as ``path, content``; unreadable bytes are replaced, an empty file is an empty text."""
    return spark.read.text(path, wholetext=True).select(
        "*", F.col("_metadata.file_path").alias("path")
    ).withColumnRenamed("value", "content")


def visible_to_users(bases: DataFrame, users: DataFrame) -> DataFrame:
    """Knowledge bases that ``users`` (``user_id``) see: ``viewer_id`` and the base's columns.

    A base that is not public has a row for its owner.  A public one, which
    everybody sees, has one row with a null ``viewer_id`` and is not repeated for all users.
    """
    live = bases.filter(F.col("is_deleted") == 0)
    viewers = users.select(F.col("user_id").alias("viewer_id")).filter("viewer_id IS NOT NULL").distinct()
    own = live.filter("type <> 'public' OR type IS NULL").join(viewers, F.col("user_id") == F.col("viewer_id"))
    public = live.filter("type = 'public'").withColumn("viewer_id", F.lit(None).cast(users.schema["user_id"].dataType))
    return own.select("viewer_id", *bases.columns).unionByName(public.select("viewer_id", *bases.columns))


def visible_bases(bases: DataFrame, user_id: int) -> DataFrame:
    """Knowledge bases a user sees: own and public ones that are not deleted, newest first."""
    seen = (F.col("is_deleted") == 0) & ((F.col("user_id") == user_id) | (F.col("type") == "public"))
    return bases.filter(seen).orderBy(F.desc("created_at"), F.desc("id"))


def active_records(records: DataFrame) -> DataFrame:
    """Review records that are not deleted, newest first per user, with their JSON columns as arrays."""
    live = records.filter("status <> '0'")
    return live.select(
        "*",
        F.from_json("file_urls", "array<string>").alias("file_url_list"),
        risk_points(F.col("risk_points_json")).alias("risk_points"),
    ).orderBy("user_id", F.desc("create_time"))


def assemble_pages(pages: DataFrame, pages_per_part: int | None = None) -> DataFrame:
    """Record text from its pages, with a title line per page: ``record_id, pages, text``.

    With ``pages_per_part`` a record comes in parts of that many pages, and
    ``part`` and ``parts`` tell which and how many; use it where a record's
    text is too long for one cell.
    """
    titled = F.concat(F.lit("【第"), F.col("page").cast("string"), F.lit("页】\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    return _in_order(pages, "record_id", "page", titled, "pages", pages_per_part)


def page_review(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Review record of each page set: ``record_id, pages, contract_text, analysis_text, risk_count, risk_points, status``.

    Pages are joined to one text, the text is cut for the analysis, and the
    model's answer on it (``answers``: ``record_id, raw``) is read as risk
    points.  A text too short for analysis has no answer and no points.
    """
    texts = truncate_contracts(assemble_pages(pages), "text")
    read = texts.join(answers.select("record_id", "raw"), "record_id", "left")
    points = F.when(~F.col("too_short"), risk_points(F.col("raw")))
    read = read.withColumn("risk_points", points)
    return read.select(
        "record_id", "pages", F.col("text").alias("contract_text"), "analysis_text",
        F.coalesce(F.array_size("risk_points"), F.lit(0)).alias("risk_count"), "risk_points", F.lit("1").alias("status"),
    )


def _in_order(rows: DataFrame, key: str, order: str, line: Column, count: str, per_part: int | None) -> DataFrame:
    """Lines of each key joined in their order, whole or in parts of ``per_part`` lines."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("t"))))
    keys = [key]
    if per_part is not None:
        place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
        rows = rows.withColumn("part", F.floor(place / per_part).cast("int"))
        keys.append("part")
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), lines.alias("ls"))
    out = whole.select(*keys, count, F.array_join("ls.t", "").alias("text"))
    if per_part is None:
        return out
    parts = whole.groupBy(key).agg((F.max("part") + 1).alias("parts"))
    return out.join(parts, key).select(key, "part", "parts", count, "text")


def is_data_line(line: Column) -> Column:
    return F.coalesce(trim_ws(line).startswith("data:"), F.lit(False))


def data_of(line: Column) -> Column:
    """What a data line carries."""
    return trim_ws(F.substring(trim_ws(line), 6, 2147483647))


def parsed_chunk(line: Column) -> Column:
    """The chunk of a data line (``type, role, content``); null for what is no JSON object and for other lines."""
    whole = F.get_json_object(data_of(line), "$")
    return F.when(is_data_line(line) & whole.isNotNull(), F.from_json(data_of(line), CHAT_LINE))


def chunk_kind(line: Column) -> Column:
    """``chunk`` for a piece of the answer, ``suggestion`` for a follow-up, else null."""
    chunk = parsed_chunk(line)
    answer = (chunk.getField("type") == "answer") & (chunk.getField("role") == "assistant")
    return F.when(answer, "chunk").when(chunk.getField("type") == "follow_up", "suggestion")


def chat_chunks(lines: DataFrame) -> DataFrame:
    """Typed chunks of a chat log: keep data lines, drop the end mark and anything that is not an answer or follow-up."""
    line = F.col("line")
    typed = lines.filter(is_data_line(line) & (data_of(line) != END_MARK)).withColumns({"chunk_type": chunk_kind(line), "j": parsed_chunk(line)})
    return typed.filter(F.col("chunk_type").isNotNull() & (F.col("j.content") != "")).select(
        *[c for c in lines.columns if c != "line"], "chunk_type", F.col("j.content").alias("text")
    )


def full_answers(chunks: DataFrame, chunks_per_part: int | None = None) -> DataFrame:
    """Answer text per message from its ordered chunks: ``message_id, chunks, text``; in parts on request, as pages are."""
    answer = chunks.filter("chunk_type = 'chunk'")
    return _in_order(answer, "message_id", "seq", F.col("text"), "chunks", chunks_per_part)


def append_new_rounds(rounds: DataFrame, path: str) -> None:
    """Append answered rounds to the history at ``path``; a round that is stored already is not stored again."""
    spark = rounds.sparkSession
    stored = spark.read.schema(rounds.schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], rounds.schema)
    fresh = rounds.join(stored.select("session_id", "id"), ["session_id", "id"], "left_anti").select(*rounds.columns)
    written(fresh, "new-rounds").write.mode("append").parquet(path)


def apply_changes(log: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Current rows from a change log: newest non-null value per field, audit times, deletions gone.

    ``log``: keys, ``version, changed, op`` and the fields.  Only aggregates, so a
    row with very many changes is combined map-side.
    """
    version = F.col("version")
    current = log.groupBy(*keys).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), version)).alias(f) for f in fields],
        F.max_by("op", "version").alias("last_op"),
        F.min("changed").alias("create_time"),
        F.max("changed").alias("update_time"),
    )
    return current.filter("last_op <> 'delete'").drop("last_op")


def partial_update(rows: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Overwrite only with non-empty new values."""
    new = broadcast_if_small(updates.select(key, *[F.col(f).alias(f"__{f}") for f in fields]))
    joined = rows.join(new, key, "left")
    kept = {f: F.coalesce(F.nullif(f"__{f}", F.lit("")), F.col(f)).alias(f) for f in fields}
    return joined.select(*[kept.get(c, F.col(c)) for c in rows.columns])


def upsert_users(logins: DataFrame, users: DataFrame) -> DataFrame:
    """First valid login of every unknown open id: ``open_id, nick_name, avatar_url, seq``."""
    valid = logins.filter(~is_blank(F.col("nick_name")) & ~is_blank(F.col("avatar_url")))
    # one row a user before the join, so that a user with very many logins is no hot key
    first = valid.groupBy("open_id").agg(F.min_by(F.struct("nick_name", "avatar_url", "seq"), "seq").alias("f"))
    return first.join(users.select("open_id").distinct(), "open_id", "left_anti").select("open_id", "f.*")


def document_status(uploads: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Lifecycle of uploads: failed on an error, done once parsed, else pending."""
    joined = uploads.join(chunk_counts, "doc_id", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("parsed"), "done").otherwise("pending")
    done = status == "done"
    return joined.select(
        *uploads.columns, status.alias("status"), F.when(done, F.coalesce("chunk_count", F.lit(0))).alias("chunk_count")
    )


def exists_in(rows: DataFrame, parents: DataFrame, key: Column, parent_key: str) -> DataFrame:
    """Rows whose parent exists."""
    ids = broadcast_if_small(parents.select(F.col(parent_key).alias("__id")).distinct())
    return rows.join(ids, key == F.col("__id"), "left_semi")
