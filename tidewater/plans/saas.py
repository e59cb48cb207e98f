"""GitHub, Slack and Notion models (staging + marts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import (
    date_diff_days,
    date_diff_hours,
    epoch_to_ts,
    surrogate_key,
    text_ts,
    trunc_day,
    trunc_week_date,
    try_cast_double,
    try_cast_int,
)
from tidewater.operators import (
    count_where,
    dedup_latest,
    lookup_join,
    outer_combine,
    running_total,
    spine_join,
    zero_safe_diff,
)
from tidewater.plans.core import Warehouse, model

c = F.col

# --- fixed values -----------------------------------------------------------
# Message subtypes that are system events, not user posts.
SYSTEM_SUBTYPES = [
    "bot_message",
    "channel_join",
    "channel_leave",
    "channel_archive",
    "channel_unarchive",
    "channel_name",
    "channel_purpose",
    "channel_topic",
    "file_share",
    "me_message",
    "thread_broadcast",
]
# ---------------------------------------------------------------------------

# ------------------------------------------------------------------ GitHub


@model("stg_github_commits")
def stg_github_commits(w: Warehouse) -> DataFrame:
    src = w.raw("github.commits")
    staged = src.select(
        surrogate_key("sha").alias("commit_id"),
        "sha",
        c("commit__message").alias("message"),
        c("commit__author__name").alias("author_name"),
        c("commit__author__email").alias("author_email"),
        c("author__login").alias("author_login"),
        c("committer__login").alias("committer_login"),
        text_ts("commit__author__date").alias("committed_at"),
        text_ts("commit__committer__date").alias("committer_date"),
        c("stats__additions").alias("additions"),
        c("stats__deletions").alias("deletions"),
        c("stats__total").alias("total_changes"),
        "_dlt_id",
    )
    latest = dedup_latest(staged, ["sha"], [c("committed_at").desc_nulls_last(), c("_dlt_id").asc()])
    return latest.drop("_dlt_id")


@model("stg_github_issues")
def stg_github_issues(w: Warehouse) -> DataFrame:
    src = w.raw("github.issues")
    staged = src.select(
        surrogate_key("id").alias("issue_id"),
        "id",
        "number",
        "title",
        "body",
        "state",
        (c("state") == F.lit("open")).alias("is_open"),
        c("pull_request").isNotNull().alias("is_pull_request"),
        c("user__login").alias("author_login"),
        c("user__id").alias("author_id"),
        "comments",
        c("reactions__total_count").alias("reactions_total"),
        "labels",
        "assignees",
        text_ts("created_at").alias("created_at"),
        text_ts("updated_at").alias("updated_at"),
        text_ts("closed_at").alias("closed_at"),
        "_dlt_id",
    )
    latest = dedup_latest(staged, ["id"], [c("updated_at").desc_nulls_last(), c("_dlt_id").asc()])
    return latest.drop("_dlt_id")


@model("stg_github_pull_requests")
def stg_github_pull_requests(w: Warehouse) -> DataFrame:
    src = w.raw("github.pull_requests").select(
        "id", "number", "title", "state", "user__login", "draft", "head__ref", "base__ref", "additions",
        "deletions", "changed_files", "commits", "review_comments", "requested_reviewers", "_dlt_id",
        *[text_ts(x).alias(x) for x in ("created_at", "updated_at", "merged_at", "closed_at")],
    )
    staged = src.select(
        surrogate_key("id").alias("pull_request_id"),
        "id",
        "number",
        "title",
        "state",
        c("merged_at").isNotNull().alias("is_merged"),
        F.coalesce(c("draft"), F.lit(False)).alias("is_draft"),
        c("user__login").alias("author_login"),
        c("head__ref").alias("head_ref"),
        c("base__ref").alias("base_ref"),
        "additions",
        "deletions",
        "changed_files",
        "commits",
        "review_comments",
        date_diff_hours("created_at", F.coalesce(c("merged_at"), c("closed_at"))).alias("cycle_time_hours"),
        "requested_reviewers",
        "created_at",
        "updated_at",
        "merged_at",
        "closed_at",
        "_dlt_id",
    )
    latest = dedup_latest(staged, ["id"], [c("updated_at").desc_nulls_last(), c("_dlt_id").asc()])
    return latest.drop("_dlt_id")


@model("github_issues", layer="table")
def github_issues(w: Warehouse) -> DataFrame:
    return w.ref("stg_github_issues")


@model("github_pull_requests", layer="table")
def github_pull_requests(w: Warehouse) -> DataFrame:
    return w.ref("stg_github_pull_requests")


def _daily(df: DataFrame, ts: str, **aggs) -> DataFrame:
    return (
        df.where(c(ts).isNotNull())
        .groupBy(trunc_day(ts).alias("activity_date"))
        .agg(*[a.alias(n) for n, a in aggs.items()])
    )


@model("github_repo_activity", layer="table")
def github_repo_activity(w: Warehouse) -> DataFrame:
    commits = w.ref("stg_github_commits")
    prs = w.ref("stg_github_pull_requests")
    daily_commits = _daily(
        commits, "committed_at",
        commit_count=F.count(F.lit(1)),
        lines_added=F.sum("additions").cast("long"),
        lines_deleted=F.sum("deletions").cast("long"),
    )
    merged = _daily(prs, "merged_at", prs_merged=F.count(F.lit(1)))
    opened = _daily(prs, "created_at", prs_opened=F.count(F.lit(1)))
    out = spine_join(
        [daily_commits, merged, opened], "activity_date",
        ["commit_count", "lines_added", "lines_deleted", "prs_merged", "prs_opened"],
    )
    return out.select(
        "activity_date", "commit_count", "lines_added", "lines_deleted",
        zero_safe_diff("lines_added", "lines_deleted").alias("net_lines"),
        "prs_merged", "prs_opened",
    ).orderBy("activity_date")


# ------------------------------------------------------------------- Slack


@model("stg_slack_channels")
def stg_slack_channels(w: Warehouse) -> DataFrame:
    src = w.raw("slack.channels")
    return src.select(
        c("id").alias("channel_id"),
        c("name").alias("channel_name"),
        "is_private",
        "is_archived",
        (~c("is_archived")).alias("is_active"),
        c("topic__value").alias("topic"),
        c("purpose__value").alias("purpose"),
        "num_members",
        epoch_to_ts("created").alias("created_at"),
        epoch_to_ts("updated").alias("updated_at"),
    )


@model("stg_slack_users")
def stg_slack_users(w: Warehouse) -> DataFrame:
    src = w.raw("slack.users")
    return src.select(
        c("id").alias("user_id"),
        c("name").alias("username"),
        "real_name",
        "display_name",
        c("profile__email").alias("email"),
        c("profile__title").alias("title"),
        c("profile__image_72").alias("profile_image_url"),
        "tz",
        "is_bot",
        "is_admin",
        "is_owner",
        c("deleted").alias("is_deleted"),
        (~c("deleted") & ~c("is_bot")).alias("is_active"),
    )


def message_flags(df: DataFrame) -> DataFrame:
    """Three-valued message flags (PRJ-8) on a staged message frame."""
    return df.select(
        "*",
        (c("thread_ts").isNotNull() & (c("thread_ts") != c("message_ts"))).alias("is_thread_reply"),
        (F.coalesce(c("reply_count"), F.lit(0)) > 0).alias("is_thread_root"),
        (c("reactions").isNotNull() & (F.coalesce(F.json_array_length("reactions"), F.lit(0)) > 0)).alias(
            "has_reactions"
        ),
        (c("subtype").isNull() | ~c("subtype").isin(*SYSTEM_SUBTYPES)).alias("is_user_message"),
    )


def stage_messages(src: DataFrame) -> DataFrame:
    """Raw message records -> staged messages with flags (batch and streaming)."""
    cast = src.select(
        epoch_to_ts(try_cast_double("ts")).alias("message_ts"),
        c("ts").alias("message_ts_raw"),
        c("channel").alias("channel_id"),
        c("user").alias("user_id"),
        "text",
        c("type").alias("message_type"),
        "subtype",
        epoch_to_ts(try_cast_double("thread_ts")).alias("thread_ts"),
        try_cast_int("reply_count").alias("reply_count"),
        "reactions",
        "files",
        "attachments",
        "blocks",
    )
    flagged = message_flags(cast)
    return flagged.select(
        "message_ts", "message_ts_raw", "channel_id", "user_id", "text", "message_type", "subtype", "thread_ts",
        "reply_count", "is_thread_reply", "is_thread_root", "has_reactions", "is_user_message",
        "files", "attachments", "blocks",
    )


@model("stg_slack_messages")
def stg_slack_messages(w: Warehouse) -> DataFrame:
    return stage_messages(w.raw("slack.messages"))


@model("slack_channel_activity", layer="table")
def slack_channel_activity(w: Warehouse) -> DataFrame:
    m = w.ref("stg_slack_messages").where(c("is_user_message") == F.lit(True))
    daily = m.groupBy("channel_id", F.date_trunc("DAY", "message_ts").cast("date").alias("activity_date")).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.count_distinct("user_id").alias("unique_users"),
        count_where(c("is_thread_reply")).alias("thread_replies"),
        count_where(c("is_thread_root")).alias("threads_started"),
        count_where(c("has_reactions")).alias("messages_with_reactions"),
    )
    ch = w.ref("stg_slack_channels").select("channel_id", "channel_name", "is_private", "is_active")
    j = lookup_join(daily, ch, "channel_id", "left")
    return j.select(
        surrogate_key("channel_id", "activity_date").alias("channel_activity_key"),
        "channel_id", "channel_name", "is_private", "is_active", "activity_date",
        "message_count", "unique_users", "thread_replies", "threads_started", "messages_with_reactions",
    )


@model("slack_user_activity", layer="table")
def slack_user_activity(w: Warehouse) -> DataFrame:
    m = w.ref("stg_slack_messages").where(c("is_user_message") == F.lit(True))
    weekly = m.groupBy("user_id", trunc_week_date("message_ts").alias("activity_week")).agg(
        F.count(F.lit(1)).alias("messages_sent"),
        F.count_distinct("channel_id").alias("channels_active_in"),
        count_where(c("is_thread_root")).alias("threads_started"),
        count_where(c("is_thread_reply")).alias("thread_replies_sent"),
        count_where(c("has_reactions")).alias("messages_with_reactions"),
    )
    users = w.ref("stg_slack_users").select("user_id", "username", "real_name", "is_bot", "is_active")
    j = lookup_join(weekly, users, "user_id", "left")
    return j.select(
        surrogate_key("user_id", "activity_week").alias("user_activity_key"),
        "user_id", "username", "real_name", "is_bot", "is_active", "activity_week",
        "messages_sent", "channels_active_in", "threads_started", "thread_replies_sent", "messages_with_reactions",
    )


# ------------------------------------------------------------------ Notion


@model("stg_notion_databases")
def stg_notion_databases(w: Warehouse) -> DataFrame:
    src = w.raw("notion.databases")
    return src.select(
        "id",
        "url",
        F.get_json_object("title", "$[0].plain_text").alias("title"),
        c("title").alias("title_raw"),
        c("description").alias("description_raw"),
        text_ts("created_time").alias("created_time"),
        text_ts("last_edited_time").alias("last_edited_time"),
        c("created_by__id").alias("created_by_id"),
        c("last_edited_by__id").alias("last_edited_by_id"),
        "properties",
    )


@model("stg_notion_pages")
def stg_notion_pages(w: Warehouse) -> DataFrame:
    src = w.raw("notion.pages")
    return src.select(
        "id",
        "url",
        text_ts("created_time").alias("created_time"),
        text_ts("last_edited_time").alias("last_edited_time"),
        c("created_by__id").alias("created_by_id"),
        c("last_edited_by__id").alias("last_edited_by_id"),
        c("parent__database_id").alias("database_id"),
        c("parent__type").alias("parent_type"),
        "archived",
        "properties",
    )


@model("stg_notion_users")
def stg_notion_users(w: Warehouse) -> DataFrame:
    src = w.raw("notion.users")
    return src.select(
        "id", "type", "name", "avatar_url", c("person__email").alias("email"),
        (c("type") == F.lit("person")).alias("is_person"),
    )


@model("notion_pages", layer="table")
def notion_pages(w: Warehouse) -> DataFrame:
    p = w.ref("stg_notion_pages").alias("p")
    d = w.ref("stg_notion_databases").select(
        c("id").alias("d_id"), c("title").alias("database_name"), c("url").alias("database_url")
    )
    users = w.ref("stg_notion_users")
    creator = users.select(c("id").alias("cr_id"), c("name").alias("created_by_name"),
                           c("email").alias("created_by_email"))
    editor = users.select(c("id").alias("ed_id"), c("name").alias("last_edited_by_name"),
                          c("email").alias("last_edited_by_email"))
    j = lookup_join(p, d, c("database_id") == c("d_id"), "left")
    j = lookup_join(j, creator, c("created_by_id") == c("cr_id"), "left")
    j = lookup_join(j, editor, c("last_edited_by_id") == c("ed_id"), "left")
    return j.select(
        c("id").alias("page_id"), c("url").alias("page_url"), "database_id", "parent_type",
        "database_name", "database_url",
        "created_by_id", "created_by_name", "created_by_email",
        "last_edited_by_id", "last_edited_by_name", "last_edited_by_email",
        "created_time", "last_edited_time",
        trunc_day("created_time").alias("created_date"),
        trunc_day("last_edited_time").alias("last_edited_date"),
        date_diff_days("created_time", "last_edited_time").alias("days_since_creation"),
        "archived", "properties",
    )


@model("notion_workspace_activity", layer="table")
def notion_workspace_activity(w: Warehouse) -> DataFrame:
    pages = w.ref("stg_notion_pages")
    edits = _daily(pages, "last_edited_time", pages_edited=F.count(F.lit(1)),
                   unique_editors=F.count_distinct("last_edited_by_id"))
    creations = _daily(pages, "created_time", pages_created=F.count(F.lit(1)))
    combined = outer_combine(edits, creations, "activity_date", ["pages_edited", "pages_created", "unique_editors"])
    combined = combined.select("activity_date", "pages_edited", "pages_created", "unique_editors")
    out = running_total(combined, [c("activity_date").asc_nulls_last()], "pages_created", "cumulative_pages_created")
    return out.orderBy("activity_date")
