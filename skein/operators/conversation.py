"""Shaping of chats, tasks and search results for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN = ["followup", "related", "end"]


def visible(messages: DataFrame) -> DataFrame:
    """Without tool messages and those of hidden types; a message without type stays."""
    return messages.where((F.col("role") != "tool") & ~F.coalesce(F.col("type"), F.lit("")).isin(HIDDEN))


def recent(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text"))
    return messages.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n).drop("__nth")


def as_assistant(role: Column, content: Column) -> tuple[Column, Column]:
    """Tool messages as the assistant's, their content as a JSON string."""
    quoted = F.regexp_replace(F.to_json(F.array(content)), r"^\[|\]$", "")  # every character that JSON escapes
    return F.when(role == "tool", "assistant").otherwise(role), F.when(role == "tool", quoted).otherwise(content)


def message_type(content: Column) -> Column:
    has = lambda k: F.get_json_object(content, f"$.{k}").isNotNull()
    return F.when(has("input"), "input").when(has("related_query"), "input_related").when(has("inquiry"), "inquiry")


def form_json(entries: Column, without: str = "files") -> Column:
    return F.to_json(F.map_filter(entries, lambda k, v: k != without))


def form_text(form: Column) -> Column:
    """Keys that are on and the free text, joined by commas, in the form's order."""
    m = F.from_json(form, "map<string,string>")
    parts = F.transform(F.filter(F.map_entries(m), lambda e: (e["value"] == "on") | ((e["key"] == "additional_query") & (e["value"] != ""))), lambda e: F.when(e["key"] == "additional_query", e["value"]).otherwise(e["key"]))
    return F.array_join(parts, ", ")


def saved(messages: DataFrame) -> DataFrame:
    """Messages of the conversations that have an answer, each closed by an end message."""
    answered = messages.where("type = 'answer'").select("conv_id").distinct()
    kept = messages.join(answered, "conv_id", "left_semi").select("conv_id", "turn", "role", "type", "text")
    end = kept.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("assistant").alias("role"), F.lit("end").alias("type"), F.lit("end").alias("text"))
    return kept.unionByName(end)


COMPONENTS = {"input": "user_message", "input_related": "user_message", "inquiry": "clarification", "answer": "answer", "related": "related_queries", "followup": "followup_panel"}


def component(role: Column, type_: Column, shared: Column) -> Column:
    """Which view shows a message; null shows nothing. On shared pages there is no way to go on."""
    shown = F.when(role == "tool", "tool_result")
    for t, name in COMPONENTS.items():
        shown = shown.when(type_ == t, F.when(shared & F.lit(t == "followup"), F.lit(None).cast("string")).otherwise(name))
    return shown


def grouped(parts: DataFrame) -> DataFrame:
    """Components of each message id in order of arrival; the first is_collapsed counts."""
    return parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "component")))["component"].alias("components"), F.min_by("is_collapsed", "seq").alias("is_collapsed"))


def history_label(ts: Column, as_of: Column) -> Column:
    days = F.datediff(as_of.cast("date"), ts.cast("date"))
    time = F.date_format(ts, "hh:mm a")
    return F.when(days == 0, F.concat(F.lit("Today, "), time)).when(days == 1, F.concat(F.lit("Yesterday, "), time)).otherwise(F.concat(F.date_format(ts, "MM/dd/yyyy"), F.lit(", "), time))


def results(hits: Column) -> Column:
    """(id, score, text) as (id, score, content)."""
    return F.transform(hits, lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), x["text"].alias("content")))


def videos(links: DataFrame, n: int = 4, order_by: str = "page_id", path: str = "/watch") -> DataFrame:
    """Links to a watch page with their host, the first n."""
    return links.where(F.expr("parse_url(url, 'PATH')") == path).select("*", F.expr("parse_url(url, 'HOST')").alias("host")).orderBy(order_by).limit(n)


def append(path: str, chats: DataFrame) -> None:
    """Saves chats (user_id, chat_id, score: time of the save, payload) as rows; the last of a key counts."""
    chats.select("user_id", "chat_id", "score", "payload").write.mode("append").parquet(path)


def latest(saved_rows: DataFrame) -> DataFrame:
    """Of each (user_id, chat_id) the payload saved last."""
    return saved_rows.groupBy("user_id", "chat_id").agg(F.max_by("payload", "score").alias("payload"), F.max("score").alias("score"))


def facets(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def page(tasks: DataFrame, text: str = "", statuses: list[str] | None = None, order_by: str = "title", descending: bool = False, size: int = 10, number: int = 0) -> DataFrame:
    """A page of the task table: case-insensitive text filter on title, set filter on status, sort, then cut."""
    if text:
        tasks = tasks.where(F.contains(F.lower("title"), F.lit(text.lower())))
    if statuses:
        tasks = tasks.where(F.col("status").isin(statuses))
    return tasks.orderBy(F.desc(order_by) if descending else F.asc(order_by), "id").offset(number * size).limit(size)


def newest(chats: DataFrame, n: int = 20) -> DataFrame:
    """Chats by their last activity, newest first."""
    return chats.orderBy(F.desc("last"), "conv_id").limit(n)


def shared(chats: DataFrame) -> DataFrame:
    """Chats that anybody may see: those with a share path."""
    return chats.where(F.coalesce(F.col("share_path"), F.lit("")) != "")


def may_share(owner: Column, user: Column) -> Column:
    return F.coalesce(owner == user, F.lit(False))


def suggestions(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def page_title(title: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(title, 1, 50), F.lit("")), F.lit("Search"))


def all_but_last(messages: Column) -> Column:
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))


def task_rows(tasks: DataFrame) -> DataFrame:
    """Tasks for display, nulls as empty texts."""
    return tasks.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in tasks.columns])


def snippets(results_: DataFrame, n: int = 3, size: int = 100) -> DataFrame:
    """The first n results of a query, texts cut to `size`."""
    return results_.where(F.col("rank") <= n).withColumn("text", F.substring("text", 1, size))
