"""A candidates table derived from the star-schema and event tables.

The test data has no candidate records, so one nested record per customer is built:
skills from purchased parts, career history from orders, engagement signals from
events.  Everything is a grouped aggregate or a per-key top-K, so a customer or a user
that owns a third of the rows is combined before the shuffle and never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.sources.readers import spread_small_scan

RECORD = ["candidate_id", "profile", "summary", "skills", "career_history", "education", "signals"]

# --- fixed values: titles of the derived records ---------------------------
TITLE_BY_SEGMENT = {
    "MACHINERY": "Senior Backend Engineer",
    "HOUSEHOLD": "Data Analyst",
    "FURNITURE": "Junior QA Engineer",
    "BUILDING": "Lead Data Engineer",
}
TITLE_BY_PRIORITY = {
    "1-URGENT": "Senior Backend Engineer",
    "2-HIGH": "Data Analyst",
    "3-MEDIUM": "Junior QA Engineer",
    "4-NOT SPECIFIED": "Lead Data Engineer",
}
OTHER_TITLE = "Platform Architect"
SKILLS_KEPT = 12
ORDERS_KEPT = 6


def _case(col: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skills_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve best skills: part names by total quantity.  At most 64 names per customer."""
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    owners = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    size = F.col("size")
    level = (
        F.when(size < 13, F.lit("beginner"))
        .when(size < 26, F.lit("intermediate"))
        .when(size < 39, F.lit("advanced"))
        .otherwise(F.lit("expert"))
    )
    per_skill = (
        items.join(owners, "l_orderkey")
        .join(parts, "l_partkey")
        .groupBy("o_custkey", "p_name")
        .agg(F.sum("l_quantity").cast("int").alias("months"), F.count("*").cast("int").alias("n"), F.max("p_size").alias("size"))
    )
    one = F.struct(
        (-F.col("months")).alias("_m"),
        F.col("p_name").alias("name"),
        level.alias("proficiency"),
        F.col("months").alias("duration_months"),
        F.col("n").alias("endorsements"),
    )
    best = F.slice(F.array_sort(F.collect_list(one)), 1, SKILLS_KEPT)
    return per_skill.groupBy("o_custkey").agg(
        F.transform(
            best, lambda s: F.struct(s["name"], s["proficiency"], s["duration_months"], s["endorsements"])
        ).alias("skills")
    )


def history_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order count and the latest orders as jobs; orders are pruned before the shuffle."""
    orders = load(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice", "o_orderstatus"
    )
    latest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    recent = orders.withColumn("place", F.row_number().over(latest)).where(F.col("place") <= ORDERS_KEPT)
    job = F.struct(
        "place",
        _case(F.col("o_orderpriority"), TITLE_BY_PRIORITY, OTHER_TITLE).alias("title"),
        F.floor(F.col("o_totalprice") / 10000).cast("int").alias("duration_months"),
        (F.col("o_orderstatus") == "O").alias("is_current"),
    )
    jobs = recent.groupBy("o_custkey").agg(
        F.transform(
            F.array_sort(F.collect_list(job)),
            lambda j: F.struct(j["title"], j["duration_months"], j["is_current"]),
        ).alias("career_history")
    )
    totals = orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return totals.join(jobs, "o_custkey")


def events_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", "event_type", "value")

    def n(kind: str) -> Column:
        return F.count(F.when(F.col("event_type") == kind, F.lit(1))).alias(kind)

    kinds = ["click", "view", "purchase", "error", "signup"]
    return events.groupBy("user_id").agg(
        F.count("*").alias("n_events"), *[n(k) for k in kinds], F.avg("value").alias("mean"), F.max("value").alias("top")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed record per customer: ``key`` plus the columns of ``RECORD``."""
    nations = load(spark, sf_dir, "nation").join(
        load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    users = events_per_user(spark, sf_dir)
    n_users = load(spark, sf_dir, "events").select(F.count_distinct("user_id")).scalar()
    people = spread_small_scan(load(spark, sf_dir, "customer")).withColumn("user_id", F.col("c_custkey") % n_users)
    joined = (
        people.join(nations, "c_nationkey", "left")
        .join(users, "user_id", "left")
        .join(skills_per_customer(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .join(history_per_customer(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    )
    key = F.col("c_custkey")
    profile = F.struct(
        F.col("c_name").alias("anonymized_name"),
        _case(F.col("c_mktsegment"), TITLE_BY_SEGMENT, OTHER_TITLE).alias("current_title"),
        F.when(key % 17 != 0, F.round(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 700, 1)).alias("years_of_experience"),
        F.translate("n_name", "_", "-").alias("location"),
        F.col("r_name").alias("country"),
    )
    summary = (
        F.when(key % 50 == 0, F.concat(F.repeat(F.lit("expert guru "), 5), F.lit("builder")))
        .when(key % 11 == 0, F.lit("x"))
        .otherwise(
            F.format_string(
                "Deployed production pipeline with monitoring handling %dk requests and %dms latency",
                F.coalesce("n_orders", F.lit(0).cast("long")),
                F.coalesce("error", F.lit(0).cast("long")),
            )
        )
    )
    school = F.struct(
        F.lit("B.Tech Computer Science").alias("degree"),
        F.concat(F.lit("tier_"), (F.col("c_nationkey") % 4 + 1).cast("string")).alias("tier"),
    )
    share = lambda part, whole: F.round(F.try_divide(part, whole), 4)
    signals = F.struct(
        share(F.col("click"), F.col("n_events")).alias("recruiter_response_rate"),
        F.round("mean", 2).alias("avg_response_time_hours"),
        (F.lit(30) + key % 70).cast("int").alias("profile_completeness_score"),
        F.col("view").alias("profile_views_received_30d"),
        F.col("purchase").alias("saved_by_recruiters_30d"),
        share(F.col("purchase"), F.col("purchase") + F.col("error")).alias("interview_completion_rate"),
        F.when(key % 7 == 0, F.lit(-1.0)).otherwise(share(F.col("signup"), F.col("n_events"))).alias("offer_acceptance_rate"),
        F.round(F.col("top") / 5, 2).alias("github_activity_score"),
        (key % 2 == 0).alias("verified_email"),
        (key % 3 == 0).alias("verified_phone"),
        (key % 5 == 0).alias("linkedin_connected"),
        (key % 2 == 0).alias("open_to_work_flag"),
        (key % 3 == 0).alias("willing_to_relocate"),
        ((key % 5) * 30).cast("int").alias("notice_period_days"),
    )
    return joined.select(
        key.alias("key"),
        F.concat(F.lit("CAND_"), F.lpad(key.cast("string"), 7, "0")).alias("candidate_id"),
        profile.alias("profile"),
        summary.alias("summary"),
        F.coalesce("skills", F.array().cast("array<struct<name:string,proficiency:string,duration_months:int,endorsements:int>>")).alias("skills"),
        F.coalesce("career_history", F.array().cast("array<struct<title:string,duration_months:int,is_current:boolean>>")).alias("career_history"),
        F.when(F.col("c_nationkey") % 4 == 3, F.array().cast("array<struct<degree:string,tier:string>>")).otherwise(F.array(school)).alias("education"),
        F.when(key % 13 != 0, signals).alias("signals"),
    )


def candidates_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as raw JSON text: ``key, raw``."""
    return candidates(spark, sf_dir).select(
        "key", F.to_json(F.struct(*RECORD), {"ignoreNullFields": "false"}).alias("raw")
    )
