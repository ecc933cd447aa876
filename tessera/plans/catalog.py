"""The engine's operators as queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import skills as S
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import clean, cluster, components, embed, quality, star
from tessera.session import scratch_dir
from tessera.sources import http, scans, sinks
from tessera.streaming import incremental

#: The invented prose holds no skill of the default dictionary.
WORDS = ("that", "with", "this", "from", "elle")
SQL_WORDS = "('that'),('with'),('this'),('from'),('elle')"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """documents as canonical postings: the first line is the title."""
    return table(spark, sf, "documents").select(
        "source",
        F.col("doc_id").cast("string").alias("source_job_id"),
        X.first_line(F.col("text")).alias("job_title_raw"),
        F.lit(None).cast("string").alias("company_raw"),
        F.col("lang").alias("location_raw"),
        F.col("text").alias("description_raw"),
        F.lit(None).cast("string").alias("url"),
        F.format_string("2024-01-%02dT10:00:00.%06d", F.col("doc_id") % 28 + 1, F.col("doc_id") % 1000000).alias("ingested_at"),
        F.format_string("2024-01-%02d", F.col("doc_id") % 28 + 1).alias("ingestion_date"),
        F.format_string("2024-01-%02dT12:00:00+02:00", F.col("doc_id") % 28 + 1).alias("posted_at_raw"),
    )


POSTINGS = r"""postings AS (
  SELECT source, doc_id::varchar job_id, lower(trim(split_part(text, chr(10), 1), ' ')) job_title, trim(lang, ' ') "location",
    lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) description, (doc_id % 28 + 1)::int AS d, doc_id,
    (DATE '2024-01-01' + (doc_id % 28)::int) ingestion_date
  FROM documents WHERE trim(split_part(text, chr(10), 1), ' ') <> '' AND trim(text, ' ') <> '')"""
TAGGED = POSTINGS + r""", tok AS (SELECT source, job_id, ingestion_date, d, unnest(regexp_split_to_array(description, '[^a-zA-Z0-9_]+')) w FROM postings),
tagged AS (SELECT source, job_id, ingestion_date, d, w skills, least(0.5::double + count(*) * 0.2::double, 0.95::double)::float::double skill_confidence
  FROM tok WHERE w IN (SELECT * FROM (VALUES %s)) GROUP BY ALL)""" % SQL_WORDS  # noqa: UP031


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_jobs(postings(spark, sf))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return star.job_skills(jobs(spark, sf), F.lit("2024-02-01").cast("timestamp"), WORDS, {})


@query(f"""WITH {TAGGED}, dim AS (SELECT skills, min(ingestion_date) first_seen, sha256(skills) skill_id FROM tagged GROUP BY 1)
SELECT t.source, dim.skill_id, count(*) n_jobs, round(avg(skill_confidence), 6) avg_confidence, min(first_seen) first_seen
FROM tagged t JOIN dim USING (skills) GROUP BY 1, 2""")
def flagship_skill_star(spark: SparkSession, sf: str) -> DataFrame:
    t = tagged(spark, sf)
    dim = star.dim_skills(t)
    fact = star.fact_job_skills(t, dim).join(dim.select("skill_id", F.col("ingestion_date").alias("first_seen")), "skill_id")
    return fact.groupBy("source", "skill_id").agg(
        F.count("*").alias("n_jobs"), F.round(F.avg("skill_confidence"), 6).alias("avg_confidence"), F.min("first_seen").alias("first_seen")
    )


@query(r"""SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) description, lower(trim(split_part(text, chr(10), 1), ' ')) title,
length(text) n FROM documents""")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", X.squeeze_lower(F.col("text")).alias("description"), X.trim_lower(X.first_line(F.col("text"))).alias("title"), F.length("text").alias("n")
    )


@query(f"WITH {POSTINGS} SELECT source, job_id, job_title, \"location\", sha256(description) description_sha, make_timestamp(2024, 1, d, 10, 0, (doc_id % 1000000) / 1e6) ingested_at, "
       "make_timestamp(2024, 1, d, 10, 0, 0) posted_at, ingestion_date FROM postings")  # fmt: skip
def clean_jobs(spark: SparkSession, sf: str) -> DataFrame:
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return jobs(spark, sf).select(
        "source", "job_id", "job_title", "location", F.sha2("description", 256).alias("description_sha"), ntz("ingested_at"), ntz("posted_at"), "ingestion_date"
    )


@query("""SELECT event_id, x.k k FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN chr(9) ELSE props END k FROM events) x
WHERE k IS NOT NULL AND trim(k, ' ') <> ''""")
def drop_broken(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("event_id") % 4
    k = F.when(m == 0, F.lit(None)).when(m == 1, F.lit("  ")).when(m == 2, F.lit("\t")).otherwise(F.col("props"))
    return clean.drop_broken(table(spark, sf, "events").select("event_id", k.alias("k")), "k")


@query("""SELECT event_id, CASE event_id % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts)
WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('day', ts) END parsed FROM events""")
def parse_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    m, f = F.col("event_id") % 6, lambda p: F.date_format("ts", p)
    text = (
        F.when(m == 0, f("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(m == 1, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(m == 2, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(m == 3, f("yyyy-MM-dd")).when(m == 4, F.lit("junk"))
    )
    return table(spark, sf, "events").select("event_id", X.parse_timestamp(text).cast("timestamp_ntz").alias("parsed"))


@query("""SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type
ORDER BY ts DESC NULLS LAST, event_id) = 1""")
def dedup_latest(spark: SparkSession, sf: str) -> DataFrame:
    return clean.latest_per_key(
        table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], [F.desc_nulls_last("ts"), F.asc("event_id")]
    )


@query("""WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id::varchar END job_id FROM events),
k AS (SELECT *, sha256(concat_ws('||', lower(event_type), coalesce(job_id, sha256(concat_ws('||', lower(event_type), lower(props), '', '', ''))))) dedup_key FROM e)
SELECT event_id, dedup_key FROM k QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY ts DESC NULLS LAST, event_id) = 1""")
def dedup_hash_fallback(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("job_id", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("user_id").cast("string")))
    none = F.lit(None).cast("string")
    parts = {"source": F.col("event_type"), "job_id": F.col("job_id"), "job_title": F.col("props"), "company": none, "location": none, "url": none}
    kept = clean.robust_deduplicate_jobs(e.select("event_id", *(c.alias(n) for n, c in parts.items()), F.col("ts").alias("ingested_at")))
    return kept.select("event_id", X.fallback_key(*(F.col(c) for c in parts)).alias("dedup_key"))


@query(f"""SELECT doc_id, (SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+')) w) x
WHERE w IN (SELECT * FROM (VALUES {SQL_WORDS}))) skills FROM documents""")
def skill_extract(spark: SparkSession, sf: str) -> DataFrame:
    found = S.extract_skills(X.tokens(F.col("text")), WORDS)
    return table(spark, sf, "documents").select("doc_id", F.nullif(F.array_join(F.array_sort(found), ","), F.lit("")).alias("skills"))


@query(f"""SELECT doc_id, (SELECT string_agg(DISTINCT CASE w WHEN 'with' THEN 'that' ELSE w END, ',' ORDER BY CASE w WHEN 'with' THEN 'that' ELSE w END)
FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+')) w) x WHERE w IN (SELECT * FROM (VALUES {SQL_WORDS}))) skills FROM documents""")
def skill_normalize(spark: SparkSession, sf: str) -> DataFrame:
    found = S.normalize_skills(S.extract_skills(X.tokens(F.col("text")), WORDS), {"with": "that"})
    return table(spark, sf, "documents").select("doc_id", F.nullif(F.array_join(F.array_sort(found), ","), F.lit("")).alias("skills"))


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+')) w FROM documents)
SELECT doc_id, w skill, least(0.5::double + count(*) * 0.2::double, 0.95::double)::float::double confidence FROM t WHERE w IN (SELECT * FROM (VALUES {SQL_WORDS})) GROUP BY 1, 2""")
def skill_confidence(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.explode(S.skill_confidence(F.col("t"), S.extract_skills(F.col("t"), WORDS))).alias("skill", "confidence"))


@query(f"WITH {TAGGED} SELECT source, job_id, ingestion_date, skills, skill_confidence, 'dictionary_v1' extraction_method FROM tagged")
def job_skills(spark: SparkSession, sf: str) -> DataFrame:
    return tagged(spark, sf).drop("processed_at", "posted_at")


@query(f"""WITH {POSTINGS} SELECT source, "location" AS lang, min(ingestion_date) ingestion_date, arg_min(job_title, (ingestion_date, job_id)) job_title, arg_min(job_id, (ingestion_date, job_id)) job_id,
arg_min(length(description), (ingestion_date, job_id))::int description_length FROM postings GROUP BY 1, 2""")
def dim_jobs(spark: SparkSession, sf: str) -> DataFrame:
    d = star.dim_jobs(jobs(spark, sf), ("source", "location"), ("ingestion_date", "job_id"))
    return d.select("source", F.col("location").alias("lang"), "ingestion_date", "job_title", "job_id", "description_length")


@query(f"WITH {TAGGED} SELECT skills, min(ingestion_date) ingestion_date, sha256(skills) skill_id FROM tagged GROUP BY 1")
def dim_skills(spark: SparkSession, sf: str) -> DataFrame:
    return star.dim_skills(tagged(spark, sf))


@query(f"WITH {TAGGED} SELECT source, job_id, sha256(skills) skill_id, skill_confidence, ingestion_date FROM tagged")
def fact_job_skills(spark: SparkSession, sf: str) -> DataFrame:
    t = tagged(spark, sf)
    return star.fact_job_skills(t, star.dim_skills(t)).drop("processed_at", "posted_at")


@query("""SELECT count(*) total, count(*) - count(nullif(event_type, 'view')) null_event_type, count(*) - count(CASE WHEN event_id % 5 <> 0 THEN value END) null_value FROM events""")
def null_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.nullif("event_type", F.lit("view")).alias("event_type"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return quality.null_metrics(e, "event_type", "value")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 7 <> 0)")
def orphan_facts(spark: SparkSession, sf: str) -> DataFrame:
    dim = table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return quality.orphans(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), dim, "l_orderkey")


@query("""WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0), f AS (SELECT count(*) facts FROM lineitem), j AS (SELECT count(*) jobs FROM o),
x AS (SELECT count(*) orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o))
SELECT facts, jobs, orphans, round(facts / jobs, 2) fact_per_job, orphans > 0 has_orphans, round(facts / jobs, 2) > 4 ratio_high, jobs = 0 no_jobs FROM f, j, x""")
def fact_ratio(spark: SparkSession, sf: str) -> DataFrame:
    dim = table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return quality.gold_metrics(table(spark, sf, "lineitem").select("l_orderkey"), dim, "l_orderkey", 4.0)


@query("SELECT count(*) \"rows\", count(DISTINCT (user_id, event_type)) distinct_rows, count(*) = count(DISTINCT (user_id, event_type)) passed FROM events")
def uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return quality.uniqueness(table(spark, sf, "events"), "user_id", "event_type")


@query("""SELECT 'lang' field, count(*) FILTER (lang = 'de') nulls, count(*) FILTER (lang = 'de') = 0 passed FROM documents
UNION ALL SELECT 'source', count(*) - count(source), count(*) = count(source) FROM documents""")
def required_fields(spark: SparkSession, sf: str) -> DataFrame:
    return quality.required_fields(table(spark, sf, "documents").select(F.nullif("lang", F.lit("de")).alias("lang"), "source"), "lang", "source")


@query("""SELECT count(*) "rows", count(*) FILTER (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) > 48 * 3600) stale,
count(*) FILTER (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) > 48 * 3600) = 0 passed FROM events""")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    return quality.freshness(table(spark, sf, "events"), "ts", F.lit("2024-01-31"), 48)


@query('SELECT count(*) "rows", count(*) >= 100 passed FROM labels')
def row_count(spark: SparkSession, sf: str) -> DataFrame:
    return quality.row_count(table(spark, sf, "labels"), 100)


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'unknown_source' WHEN 2 THEN 'empty_id' WHEN 3 THEN 'bad_url' WHEN 4 THEN 'bad_time' ELSE 'unknown_field' END errors FROM events""")
def record_validation(spark: SparkSession, sf: str) -> DataFrame:
    m, s = F.col("event_id") % 6, lambda c: F.lit(c)
    record = F.struct(
        F.when(m == 1, s("elsewhere")).otherwise(s("linkedin")).alias("source"),
        F.when(m == 2, s("")).otherwise(F.col("event_id").cast("string")).alias("job_id"),
        F.when(m == 3, s("not a url")).otherwise(s("https://example.org/a")).alias("url"),
        F.when(m == 4, s("soon")).otherwise(F.col("ts").cast("string")).alias("scraped_at"),
        F.when(m == 5, s("x")).alias("colour"),
    )
    checked = quality.validate_records(table(spark, sf, "events").select("event_id", F.to_json(record).alias("json")))
    return checked.select("event_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def scan_window(spark: SparkSession, sf: str) -> DataFrame:
    return scans.scan_window(table(spark, sf, "events").select("event_id", "ts"), "ts", datetime(2024, 1, 20), 10)


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def scan_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return scans.scan_partitions(table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["de", "fr"])


@query("SELECT DISTINCT ts::date AS \"day\" FROM events")
def list_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return scans.list_partitions(table(spark, sf, "events").select(F.to_date("ts").alias("day")), "day")


@query("SELECT event_id, ts::date AS \"day\" FROM events WHERE ts::date >= DATE '2024-01-11'")
def scan_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """What the ledger lacks after a first run up to 10 January."""
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    ledger = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    scans.mark_processed(e.where("day < DATE '2024-01-11'"), "day", ledger, "silver", "events", F.lit("2024-02-01"))
    return scans.unprocessed(e, "day", scans.read_ledger(spark, ledger), "silver", "events")


@query("SELECT event_id, value, json_extract(props, '$.k')::int k, ts::date::varchar AS \"day\" FROM events")
def roundtrip_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{scratch_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "value", F.from_json("props", "k int").alias("payload"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    sinks.write_jsonl(e, out, ("day",))
    back = scans.scan(spark, out, "json", e.schema)
    return back.select("event_id", "value", "payload.k", F.col("day").cast("string").alias("day"))


@query("SELECT event_id, user_id, event_type, ts FROM events WHERE event_type IN ('click', 'view')")
def roundtrip_parquet(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{scratch_dir(spark)}/parquet-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    for _ in range(2):  # twice leaves what once leaves
        sinks.write_parquet(e, out, ("event_type",))
    return scans.scan_partitions(scans.scan(spark, out), "event_type", ["click", "view"]).select(*e.columns)


@query("SELECT r_regionkey AS key, r_name AS name, NULL::double AS balance FROM region UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    frame = lambda t, **c: table(spark, sf, t).select(*(F.col(v).alias(k) for k, v in c.items()))
    return clean.union_all(
        [frame("region", key="r_regionkey", name="r_name").withColumn("key", F.col("key").cast("long")), frame("customer", key="c_custkey", name="c_name", balance="c_acctbal"), frame("supplier", key="s_suppkey", balance="s_acctbal")]
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'usajobs' ELSE 'adzuna' END source, 'T' || lang job_title_raw, source company_raw, upper(lang) location_raw,
sha256(text) description_raw, 'http://x/' || doc_id url, 'full' employment_type_raw, CASE WHEN doc_id % 2 = 1 THEN 'permanent' END contract_type_raw,
CASE WHEN doc_id % 4 <> 2 THEN doc_id + 0.5::double END salary_min_raw, CASE WHEN doc_id % 4 <> 2 THEN doc_id + 1.5::double END salary_max_raw,
CASE WHEN doc_id % 2 = 0 THEN 'USD' END currency_raw, '2024-01-20T00:00:00' posted_at_raw, '2024-01-01T00:00:00.000000' ingested_at FROM documents""")
def normalize_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of both services, every second usajobs record without pay."""
    d, created, full = table(spark, sf, "documents"), F.lit("2024-01-20T00:00:00"), F.lit("full")
    id_, title, url = F.col("doc_id").cast("string"), F.concat(F.lit("T"), "lang"), F.concat(F.lit("http://x/"), "doc_id")
    low, high, name = F.col("doc_id") + F.lit(0.5).cast("double"), F.col("doc_id") + F.lit(1.5).cast("double"), "display_name"
    a = {
        "id": id_, "title": title, "company": F.struct(F.col("source").alias(name)), "redirect_url": url, "location": F.struct(F.upper("lang").alias(name)),
        "description": F.col("text"), "contract_time": full, "contract_type": F.lit("permanent"), "salary_min": low, "salary_max": high, "created": created,
    }
    pay = F.filter(F.array(F.struct(low.alias("MinimumRange"), high.alias("MaximumRange"))), lambda _: F.col("doc_id") % 4 != 2)
    u = {
        "PositionID": id_, "PositionTitle": title, "OrganizationName": F.col("source"), "PositionLocationDisplay": F.upper("lang"), "PositionURI": url,
        "UserArea": F.struct(F.struct(F.col("text").alias("JobSummary")).alias("Details")), "PositionSchedule": F.array(F.struct(full.alias("Name"))),
        "PositionRemuneration": pay, "PublicationStartDate": created,
    }
    record = lambda fields: F.struct(*(c.alias(n) for n, c in fields.items()))
    of_u, usa = F.to_json(F.struct(record(u).alias("MatchedObjectDescriptor"))), F.col("doc_id") % 2 == 0
    raw = d.select(F.when(usa, "usajobs").otherwise("adzuna").alias("source"), F.when(usa, of_u).otherwise(F.to_json(record(a))).alias("raw_payload"))
    flat = clean.flatten_envelope(http.envelope(raw, "r1", "q", None, "2024-01-01T00:00:00.000000"))
    return flat.withColumns({"doc_id": F.col("source_job_id").cast("long"), "description_raw": F.sha2("description_raw", 256)}).drop("source_job_id")


@query("""SELECT vec_id, list_transform(embedding, lambda x: round(x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))), 9)) v FROM embeddings""")
def vector_normalize(spark: SparkSession, sf: str) -> DataFrame:
    n = V.normalize(V.doubles(F.col("embedding")))
    return table(spark, sf, "embeddings").select("vec_id", F.transform(n, lambda x: F.round(x, 9)).alias("v"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0")
def valid_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e, m = V.doubles(F.col("embedding")), F.col("vec_id") % 3
    bad = F.when(m == 1, F.transform(e, lambda x: F.lit(float("nan")))).when(m == 2, F.array().cast("array<double>")).otherwise(e)
    return table(spark, sf, "embeddings").where(V.valid(bad)).select("vec_id")


@query("""WITH p AS (SELECT user_id, value w, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 pos FROM events JOIN embeddings ON event_id % 500 = vec_id)
SELECT user_id AS job_id, pos::int pos, round(sum(w * x::double) / sum(w), 6) m, count(*) skill_count FROM p GROUP BY 1, 2""")
def job_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return _job_embeddings(spark, sf).select("job_id", F.posexplode("embedding").alias("pos", "m"), "skill_count").withColumn("m", F.round("m", 6))


def _job_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 500).alias("skill_id"), F.col("value").alias("skill_confidence"))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("skill_id"), V.doubles(F.col("embedding")).alias("embedding"), F.lit(True).alias("is_active"), F.lit("v1").alias("model_version"))
    return embed.job_embeddings(e, v, "v1")


@query("""SELECT sha256(w) skill_id, w skills, 384 embedding_dim, 'hashed-ngrams' model_name, TRUE is_active, 1.0::double norm
FROM (SELECT DISTINCT event_type w FROM events)""")
def skill_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    dim = table(spark, sf, "events").select(F.col("event_type").alias("skills"), X.surrogate_key(F.col("event_type")).alias("skill_id"))
    return embed.skill_embeddings(dim).select(
        "skill_id", "skills", F.size("embedding").alias("embedding_dim"), "model_name", "is_active", F.round(V.norm(F.col("embedding")), 9).alias("norm")
    )


CENTROIDS = """c AS (SELECT label, pos, avg(x) c FROM (SELECT label, unnest(embedding)::double x, generate_subscripts(embedding, 1) pos FROM embeddings) GROUP BY 1, 2),
d AS (SELECT vec_id, e.label, 1 - sum(x * c) dist FROM (SELECT vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) pos FROM embeddings) e
JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY 1, 2)"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster_id"), V.doubles(F.col("embedding")).alias("v"))
    c = embed.weighted_mean_vectors(e.withColumn("w", F.lit(1.0)), "cluster_id", "v", "w").withColumnRenamed("embedding", "centroid_vector")
    return cluster.distance_to_centroid(e, c, "v")


@query(f"WITH {CENTROIDS} SELECT vec_id, label AS cluster_id, round(dist, 6) distance_to_centroid FROM d")
def distance_to_centroid_given_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("vec_id", "cluster_id", F.round("distance_to_centroid", 6).alias("distance_to_centroid"))


@query(f"WITH {CENTROIDS} SELECT label AS cluster_id, count(*) cluster_size, round(avg(dist), 6) avg_distance FROM d GROUP BY 1")
def cluster_stats_given_labels(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster_stats(_labelled(spark, sf)).select("cluster_id", "cluster_size", F.round("avg_distance_to_centroid", 6).alias("avg_distance"))


def _clusters(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), V.normalize(V.doubles(F.col("embedding"))).alias("embedding_normalized"))
    return cluster.build_job_clusters(spark, e, "v1", (5, 10), created_at=F.lit("2024-02-01").cast("timestamp"))


@query()
def cluster_membership(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)["ml_job_membership"]


@query()
def cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)["ml_job_clusters"]


@query()
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)["ml_job_centroids"]


@query()
def model_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)["ml_job_cluster_metadata"]


@query("SELECT vec_id AS job_id, TRUE AS nearest, TRUE AS distance_right FROM embeddings")
def cluster_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector against all centres, which are a few rows: whether its own is the nearest, and its distance the one that was told."""
    c = _clusters(spark, sf)
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), V.normalize(V.doubles(F.col("embedding"))).alias("v"))
    centres = F.broadcast(c["ml_job_centroids"].agg(F.collect_list(F.struct("cluster_id", "centroid_vector")).alias("centres")))
    far = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    all_ = v.join(c["ml_job_membership"], "job_id").join(centres)  # one row
    own = F.filter("centres", lambda s: s["cluster_id"] == F.col("cluster_id"))[0]["centroid_vector"]
    least = F.array_min(F.transform("centres", lambda s: far(F.col("v"), s["centroid_vector"])))
    return all_.select("job_id", (far(F.col("v"), own) <= least + 1e-9).alias("nearest"), (F.abs(1 - V.dot(F.col("v"), own) - F.col("distance_to_centroid")) < 1e-9).alias("distance_right"))


@query()
def ml_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = _clusters(spark, sf)
    return quality.ml_metrics(c["ml_job_membership"], c["ml_job_cluster_metadata"])


@query("SELECT count(DISTINCT user_id) jobs_embedded, count(*) = 0 none_embedded FROM events JOIN embeddings ON event_id % 500 = vec_id")
def feature_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.feature_metrics(_job_embeddings(spark, sf))


@query("""WITH RECURSIVE n AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) v FROM embeddings),
pairs AS (SELECT a.vec_id a, b.vec_id b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND 1 - list_cosine_similarity(a.v, b.v) <= 0.5),
r(id, c) AS (SELECT vec_id, vec_id FROM n UNION SELECT r.id, pairs.b FROM r JOIN pairs ON r.c = pairs.a)
SELECT id AS "position", min(c) component FROM r GROUP BY 1""")
def skill_components(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("position"), "embedding")
    return components.similar_components(e, "position", "embedding", 0.5)


@query(f"""{SQL["skill_components"].removesuffix('SELECT id AS "position", min(c) component FROM r GROUP BY 1')},
parts AS (SELECT id, min(c) component FROM r GROUP BY 1),
means AS (SELECT component, pos, avg(x) m FROM (SELECT component, unnest(v) x, generate_subscripts(v, 1) pos FROM parts JOIN n ON id = vec_id) GROUP BY 1, 2),
vectors AS (SELECT component, list(round(m, 6) ORDER BY pos) embedding FROM means GROUP BY 1),
names AS (SELECT component, 's' || list(id ORDER BY length(id::varchar), id)[1] canonical, list('S' || id ORDER BY id) aliases FROM parts GROUP BY 1)
SELECT component, canonical, aliases, embedding FROM names JOIN vectors USING (component)""")
def skill_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("position"), F.concat(F.lit("S"), F.col("vec_id")).alias("skills"), "embedding")
    return components.skill_synonyms(e, 0.5).withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6)))


@query("SELECT event_id, user_id, value FROM events")
def stream_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of the stream over the same files append each row once."""
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    e.write.parquet(f"{root}/in")
    for _ in range(2):
        incremental.append_new_files(spark, f"{root}/in", e.schema, f"{root}/state", f"{root}/out", lambda d: d.select("event_id", "user_id", "value"))
    return spark.read.parquet(f"{root}/out")


@query("""SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) = 1""")
def stream_dedup_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Three files, one micro-batch each; the stored table always holds the latest row of each key."""
    root = f"{scratch_dir(spark)}/upsert-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    e.repartition(3, "event_id").write.parquet(f"{root}/in")
    order = [F.desc_nulls_last("ts"), F.asc("event_id")]
    incremental.upsert_new_files(spark, f"{root}/in", e.schema, f"{root}/state", f"{root}/out", ["user_id", "event_type"], order, max_files=1, buckets=8)
    return sinks.read_upserted(spark, f"{root}/out")


@query(f"WITH {TAGGED} SELECT source, job_id, sha256(skills) skill_id, skill_confidence, ingestion_date FROM tagged")
def pipeline_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """bronze JSON lines, silver and gold as stages over a fresh root; the fact table."""
    from tessera import tables
    from tessera.plans import stages

    cfg = stages.Config(root=f"{scratch_dir(spark)}/root-{uuid.uuid4().hex}", run_ts=datetime.fromisoformat("2024-02-01T00:00:00+00:00"), dictionary=WORDS, max_fact_ratio=20)
    p = postings(spark, sf)
    payload = F.struct(*((F.col(c) if c in p.columns else F.lit(None)).cast(tables.CANONICAL[c].dataType).alias(c) for c in tables.CANONICAL.fieldNames()))
    meta = F.struct(F.lit("r1").alias("run_id"), "source", F.lit("q").alias("query"), F.lit(None).cast("string").alias("location"), F.col("ingested_at").alias("started_at"), F.lit("v1").alias("canonical_schema_version"))
    env = p.select(meta.alias("ingestion_metadata"), F.lit(None).cast("string").alias("raw_payload"), payload.alias("payload"), "ingestion_date", F.lit("tables").alias("source"), F.lit("r1").alias("run_id"))
    sinks.write_jsonl(env, cfg.path("bronze_jobs"), ("ingestion_date", "source", "run_id"))
    for stage in ("silver", "gold", "silver"):  # the second time there is nothing new
        stages.STAGES[stage].run(spark, cfg)
    return spark.read.parquet(cfg.path("gold_fact_job_skills")).select("source", "job_id", "skill_id", "skill_confidence", "ingestion_date")
