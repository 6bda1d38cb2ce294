"""Outreach lists, send logs and their statistics. as_of is a parameter everywhere, never the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadmill.operators.ordering import preceding, running

AS_OF = "2024-01-30 12:00:00"


def status_statistics(log: DataFrame) -> DataFrame:
    """Counts in all, by status and by mode (where known), with the success rate of each, in one pass."""
    rows = log.groupingSets([[], ["send_status"], ["mode"]], "send_status", "mode").agg(F.count("*").alias("n"), F.count_if(F.col("send_status") == "success").alias("n_success"), F.grouping("mode").alias("by_mode"))
    rows = rows.where("by_mode = 1 or mode is not null")
    return rows.select("send_status", "mode", "n", F.round(100.0 * F.col("n_success") / F.col("n"), 2).alias("success_rate"))


def latest_sends(log: DataFrame, status: str, n: int, skip: int = 0) -> DataFrame:
    return log.where(F.col("send_status") == status).orderBy(F.desc("sent_at"), F.desc("id")).offset(skip).limit(n).select("id", "site", "mode")


def sent_today(log: DataFrame, as_of: str = AS_OF) -> DataFrame:
    day = F.to_date(F.lit(as_of).cast("timestamp"))
    return log.where(F.to_date("sent_at") == day).groupBy("send_status").agg(F.count("*").alias("n"))


def latest_state(log: DataFrame) -> DataFrame:
    """The last status of each site; ties by id."""
    last = F.max_by(F.struct("send_status", "id"), F.struct("sent_at", "id")).alias("last")
    return log.groupBy("site").agg(last).select("site", F.col("last.send_status").alias("status"), "last.id")


def state_shares(log: DataFrame) -> DataFrame:
    counts = latest_state(log).groupBy("status").agg(F.count("*").alias("n"))
    return counts.select("status", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).alias("share"))


def gaps(log: DataFrame, seconds: int) -> DataFrame:
    """Sends to a site that came sooner after the last one than the least gap."""
    rows = preceding(log.select("id", "site", F.unix_micros("sent_at").alias("at")), "site", ["at", "id"], "at", "last")
    return rows.select("id", "site", (F.col("at") - F.col("last")).alias("gap_us")).where(F.col("gap_us") < seconds * 1_000_000)


def sent_history(log: DataFrame) -> DataFrame:
    """Site and its last success: the state that an upsert keeps."""
    return log.where("send_status = 'success'").groupBy("site").agg(F.max(F.unix_micros("sent_at")).alias("sent_us"), F.count("*").alias("n"))


def hourly_counts(log: DataFrame) -> DataFrame:
    """Sends by hour and status; on a stream, with a watermark, the same expression counts late data too."""
    return log.groupBy(F.window("sent_at", "1 hour").alias("w"), "send_status").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("hour_us"), "send_status", "n")


def sliding_hours(log: DataFrame, cap: int, every: str = "5 minutes") -> DataFrame:
    """Sends of each window of an hour, one beginning every few minutes, and whether they are over the cap; on a stream, with a watermark, the
    same expression gives each window once no more can come."""
    counts = log.groupBy(F.window("sent_at", "1 hour", every).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("send_status") == "success").alias("n_success"))
    return counts.select(F.unix_micros("w.start").alias("from_us"), F.unix_micros("w.end").alias("to_us"), "n", "n_success", (F.col("n") > cap).alias("over_cap"))


def mailable(targets: DataFrame, history: DataFrame, as_of: str = AS_OF, days: int = 30, blacklist: tuple[str, ...] = ("example.com", "test.com", "localhost")) -> DataFrame:
    """Rows of targets(email, ...) with an address, not sent to within the cooldown by history(email, sent_at), whose domain isn't blacklisted."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    recent = history.where(F.col("sent_at") > since).select("email").distinct()
    domain = F.lower(F.coalesce(F.get(F.split("email", "@"), F.lit(1)), F.lit("")))
    return targets.where(F.col("email").isNotNull() & (F.col("email") != "") & ~domain.isin(*blacklist)).join(recent, "email", "left_anti")


def capped_today(rows: DataFrame, cap: int, by: str, log: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """The first rows of the day's list: cap less the successful sends of the day. Only the first cap rows meet in one task."""
    n = sent_today(log, as_of).where("send_status = 'success'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__sent"))
    first = rows.orderBy(by).limit(cap).withColumn("place", F.row_number().over(Window.partitionBy().orderBy(by)).cast("long"))
    return first.crossJoin(F.broadcast(n)).where(F.col("place") <= F.lit(cap) - F.col("__sent")).drop("__sent")


def upserted_history(history: DataFrame, sends: DataFrame) -> DataFrame:
    """The last send of each address: the state history(email, sent_at) after the given sends."""
    return history.select("email", "sent_at").unionByName(sends.select("email", "sent_at")).groupBy("email").agg(F.max("sent_at").alias("sent_at"))


def evicted_history(history: DataFrame, as_of: str = AS_OF, older_than_days: int | None = None) -> DataFrame:
    """Without the sends of that many days ago and older; without any if no number is given."""
    if older_than_days is None:
        return history.where("false")
    return history.where(F.col("sent_at") > F.lit(as_of).cast("timestamp") - F.expr(f"interval {older_than_days} days"))


def found_sends(log: DataFrame, n: int, skip: int = 0, **equal: object) -> DataFrame:
    """Sends with the given values, newest first; ties by id. A value of None asks nothing."""
    for column, value in equal.items():
        log = log if value is None else log.where(F.col(column) == value)
    return log.orderBy(F.desc("sent_at"), F.desc("id")).offset(skip).limit(n)


def send_statistics(log: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Sends in all and today, by status (null: in all), with the number of recipients."""
    today = F.to_date("sent_at") == F.to_date(F.lit(as_of).cast("timestamp"))
    rows = log.groupingSets([[], ["send_status"]], "send_status").agg(F.count("*").alias("n"), F.count_if(today).alias("n_today"), F.countDistinct("site").alias("n_recipients"))
    return rows.select("send_status", "n", "n_today", "n_recipients")


def campaign_runs(log: DataFrame, details: int = 3) -> DataFrame:
    """One run a day and mode: sends, successes, failures, and the first failed recipients in order of id. Only so many failures a run
    outlive a task."""
    dated = log.withColumn("day", F.to_date("sent_at"))
    totals = dated.groupBy("day", "mode").agg(F.count("*").alias("total"), F.count_if(F.col("send_status") == "success").alias("successful"))
    place = F.row_number().over(Window.partitionBy("day", "mode").orderBy("id", "site", "send_status"))
    first = dated.where(F.col("send_status") != "success").withColumn("place", place).where(F.col("place") <= details)
    failed = first.groupBy(F.col("day").alias("d"), F.col("mode").alias("m")).agg(F.array_sort(F.collect_list(F.struct("id", "site", "send_status"))).alias("details"))
    same = F.col("day").eqNullSafe(F.col("d")) & F.col("mode").eqNullSafe(F.col("m"))
    rows = totals.join(failed.hint("merge"), same, "left").drop("d", "m").withColumn("details", F.coalesce("details", F.array().cast("array<struct<id:bigint,site:bigint,send_status:string>>")))
    return rows.withColumn("failed", F.col("total") - F.col("successful"))


def rolled_up(runs: DataFrame) -> DataFrame:
    """day, mode, totals and the first failures of each run, as text."""
    first = F.array_join(F.transform(F.slice("details", 1, 3), lambda d: F.concat_ws(":", d["id"].cast("string"), d["send_status"])), ",")
    return runs.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "mode", "total", "successful", "failed", first.alias("first_failures"))


def campaign_statistics(runs: DataFrame, history: DataFrame) -> DataFrame:
    """Runs, sends, failures, and recipients ever reached."""
    reached = history.agg(F.count("*").alias("unique_recipients"))
    return runs.agg(F.count("*").alias("total_campaigns"), F.sum("successful").alias("total_sent"), F.sum("failed").alias("total_failed")).crossJoin(F.broadcast(reached))  # two single rows


def submission_summary(log: DataFrame) -> DataFrame:
    """Outcome classes with their shares of all posts."""
    counts = log.groupBy("send_status").agg(F.count("*").alias("n"))
    return counts.select("send_status", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1).alias("share"))  # a handful of classes


def valid_addresses(rows: DataFrame, column: str) -> Column:
    """One sign, a local part, and a domain with a dot."""
    parts = F.split(F.coalesce(F.col(column), F.lit("")), "@")
    return (F.size(parts) == 2) & (parts[0] != "") & F.contains(F.get(parts, F.lit(1)), F.lit("."))


def recipients(rows: DataFrame, subject: str, body: str) -> DataFrame:
    """rows(page_id, email, company_name) with valid addresses, names defaulted, and {field} and {{field}} of both texts filled."""
    name = F.coalesce(F.nullif(F.trim("company_name"), F.lit("")), F.lit("御社"))
    filled = rows.where(valid_addresses(rows, "email")).select("page_id", "email", name.alias("company_name"))

    def of(text: str) -> Column:
        out = F.lit(text)
        for c in ("company_name", "email"):
            out = F.replace(F.replace(out, F.lit("{{" + c + "}}"), F.col(c)), F.lit("{" + c + "}"), F.col(c))
        return out

    return filled.select("page_id", "email", "company_name", of(subject).alias("subject"), of(body).alias("body"))


#: What a letter says where no template is given. Fixed values.
DEFAULT_SUBJECT = "{company_name}様へのご提案"
DEFAULT_MESSAGE = "\n{company_name}様の新製品・サービスについてお問い合わせさせていただきたくご連絡いたしました。\n\n弊社では、企業様のビジネス成長をサポートするサービスを提供しております。\n\n詳細につきましてはお手数ですが、お気軽にお問い合わせください。\n"
DEFAULT_BODY = "\n{company_name}様\n\nお世話になっております。\n{sender_name}と申します。\n\n{message_body}\n\nご不明な点がございましたら、お気軽にお問い合わせください。\n\nよろしくお願いいたします。\n\n{sender_name}\n{sender_email}\n"


def letters(rows: DataFrame, sender_name: str, sender_email: str, subject: str = DEFAULT_SUBJECT, body: str = DEFAULT_BODY, message: str = DEFAULT_MESSAGE) -> DataFrame:
    """rows(page_id, url, email, company_name) with valid addresses as letters: company_name (a default where there is none), subject and body, with
    {field} and {{field}} filled from company_name, sender_name, sender_email, message_body and website_url."""
    name = F.coalesce(F.nullif(F.trim("company_name"), F.lit("")), F.lit("御社"))
    fields = {"company_name": F.col("company_name"), "sender_name": F.lit(sender_name), "sender_email": F.lit(sender_email), "website_url": F.coalesce("url", F.lit(""))}

    def filled(text: str, known: dict[str, Column]) -> Column:
        out = F.lit(text)
        for c, value in known.items():
            out = F.replace(F.replace(out, F.lit("{{" + c + "}}"), value), F.lit("{" + c + "}"), value)
        return out

    own = rows.where(valid_addresses(rows, "email")).select("page_id", "url", "email", name.alias("company_name")).withColumn("message_body", filled(message, fields))
    whole = {"message_body": F.col("message_body")} | fields
    return own.select("page_id", "email", "company_name", "message_body", filled(subject, whole).alias("subject"), filled(body, whole).alias("body"))


def form_targets(profiles: DataFrame, skip_with_email: bool = False) -> DataFrame:
    """Every profile with the decision whether its form is posted to, and why not."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(blank("form_url"), "no form URL").when(blank("company_name"), "no company name").when(F.lit(skip_with_email) & ~blank("email"), "has email")
    return profiles.select("page_id", F.when(reason.isNull(), "submit").otherwise("skip").alias("decision"), reason.alias("reason"))


def polite_times(pages: DataFrame, gap_seconds: int, start: str = AS_OF) -> DataFrame:
    """When each page is fetched: pages of a site follow each other by the gap, in order of page_id."""
    site = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    rows = running(pages.select("page_id", site.alias("site")), "site", ["page_id"], "place")
    return rows.select("page_id", "site", (F.unix_seconds(F.lit(start).cast("timestamp")) + (F.col("place") - 1) * gap_seconds).cast("long").alias("at_seconds"))


def delayed(targets: DataFrame, per_minute: int, start: str = AS_OF) -> DataFrame:
    """The second at which each row of a list with a place is sent, so many a minute over the whole list."""
    return targets.withColumn("at_seconds", (F.unix_seconds(F.lit(start).cast("timestamp")) + F.floor((F.col("place") - 1) * 60 / F.lit(per_minute))).cast("long"))
