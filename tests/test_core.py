"""Operators of the engine on small rows: nulls, ties, repeats, empties."""

from __future__ import annotations

import datetime as dt
import json
import logging
import os
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import skills as S
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import clean, cluster, components, embed, quality, star
from tessera.plans import logs, settings, stages
from tessera.sources import http, scans, sinks


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-02T10:00:00.123456", "2024-01-02 10:00:00.123456"), ("2024-01-02T10:00:00+02:00", "2024-01-02 08:00:00"), ("2024-01-02T10:00:00Z", "2024-01-02 10:00:00"),
        ("2024-01-02", "2024-01-02 00:00:00"), ("junk", None), ("", None), (None, None),
    ],
)
def test_timestamps(spark, text, want):
    assert one(spark, X.parse_timestamp(F.lit(text)).cast("string")) == want


def test_skills(spark):
    t = X.tokens(F.lit("Python, PYTHON python sql c++"))
    assert one(spark, S.extract_skills(t)) == ["python", "sql"] and one(spark, S.extract_skills(F.lit(None).cast("array<string>"))) == []
    assert one(spark, S.normalize_skills(F.array(F.lit("py spark"), F.lit("pyspark")))) == ["pyspark"]
    assert one(spark, S.skill_confidence(t, S.extract_skills(t))) == {"python": pytest.approx(0.95, abs=1e-6), "sql": 0.699999988079071}
    assert one(spark, S.ngram_tokens(F.split(F.lit("google cloud"), " "), 3)) == ["google", "cloud", "google cloud"]


def test_clean_and_dedup(spark):
    cols = "source string, source_job_id string, job_title_raw string, company_raw string, location_raw string, description_raw string, url string, ingested_at string, ingestion_date string, posted_at_raw string"
    rows = [
        ("a", "1", " Data  Engineer ", None, " X ", "\tSome\n text ", None, "2024-01-01", "2024-01-01", None), ("a", "1", "Newer", None, "X", "t", None, "2024-01-03", "2024-01-03", None),
        ("a", "1", "No time", None, "X", "t", None, None, "2024-01-03", None), ("b", "1", "Other", None, "X", "t", None, "2024-01-01", "2024-01-01", None),
        ("a", None, "No id", None, "X", "t", None, "2024-01-01", "2024-01-01", None), ("a", None, "No id", None, "X", "t", None, "2024-01-02", "2024-01-01", None),
        ("a", "2", "   ", None, "X", "t", None, "2024-01-01", "2024-01-01", None), ("a", "3", "\t", None, "X", "t", None, "2024-01-01", "2024-01-01", None),
    ]
    jobs = clean.clean_jobs(spark.createDataFrame(rows, cols))
    assert jobs.count() == 7 and jobs.where("job_title = 'data  engineer' AND description = 'some text'").count() == 1
    kept = {(r["source"], r["job_id"]): r["job_title"] for r in clean.deduplicate_jobs(jobs).collect()}
    assert kept == {("a", "1"): "newer", ("b", "1"): "other", ("a", "3"): "\t"}
    assert clean.robust_deduplicate_jobs(jobs).count() == 4
    with pytest.raises(ValueError):
        clean.union_all([])


def test_star(spark):
    jobs = spark.createDataFrame([("a", "1", "sql sql"), ("a", "2", "none"), ("a", "3", None)], "source string, job_id string, description string").withColumn("ingestion_date", F.lit("2024-01-01").cast("date"))
    t = star.job_skills(jobs)
    dim = star.dim_skills(t)
    assert [(r["job_id"], r["skills"]) for r in t.collect()] == [("1", "sql")] and star.fact_job_skills(t, dim).count() == 1
    assert star.dim_jobs(jobs.withColumns({"job_title": F.lit("x"), "company": F.lit(None).cast("string"), "location": F.lit(""), "posted_at": F.lit(None).cast("timestamp")})).count() == 3


def test_quality(spark):
    empty = spark.createDataFrame([], "a int, ts timestamp")
    assert quality.null_metrics(empty, "a").first().asDict() == {"total": 0, "null_a": 0}
    assert quality.uniqueness(spark.createDataFrame([(1,), (None,), (None,)], "a int"), "a").first()["distinct_rows"] == 2
    assert quality.freshness(empty, "ts", F.lit("2024-01-01"), 1).first()["passed"] and not quality.row_count(empty).first()["passed"]
    assert quality.gold_metrics(empty.select("a"), empty.select("a"), "a").first()["fact_per_job"] == 0.0
    good = {"source": "linkedin", "job_id": "1", "scraped_at": "2024-01-01", "industry": "x"}
    df = spark.createDataFrame([(json.dumps(good),), (json.dumps(good | {"source": "indeed"}),), ("{",)], "json string")
    valid, bad = quality.split_valid(df)
    assert valid.count() == 1 and sorted(tuple(r["errors"]) for r in bad.collect())[-1] == ("unknown_field",)


def test_vectors(spark):
    e = spark.createDataFrame([("s", [3.0, 4.0], True, "v1"), ("t", [1.0, 0.0], True, "v1"), ("u", [9.0, 9.0], False, "v1")], "skill_id string, embedding array<double>, is_active boolean, model_version string")
    f = spark.createDataFrame([("j", "s", 1.0), ("j", "t", 3.0), ("j", "u", 5.0), ("k", "s", 0.0)], "job_id string, skill_id string, skill_confidence double")
    got = {r["job_id"]: r for r in embed.job_embeddings(f, e, "v1").collect()}
    assert got["j"]["embedding"] == [1.5, 1.0] and got["j"]["skill_count"] == 2 and got["k"]["embedding"] == [None, None]
    bad = spark.createDataFrame([(None,), ([],), ([float("nan")],), ([None],), ([0.0],)], "v array<double>")
    assert bad.where(V.valid(F.col("v"))).count() == 1 and one(spark, V.normalize(F.array(F.lit(0.0)))) == [0.0]


def test_cluster_errors(spark):
    none = spark.createDataFrame([("a", None)], "job_id string, embedding_normalized array<double>")
    with pytest.raises(ValueError):
        cluster.build_job_clusters(spark, none, "v1")


def test_synonyms(spark):
    s = spark.createDataFrame([(0, "PySpark", [1.0, 0.0]), (1, "spark", [1.0, 0.1]), (2, "Flink", [0.0, 1.0]), (3, "SPARC", [1.0, 0.2])], "position int, skills string, embedding array<double>")
    got = {r["canonical"]: r["aliases"] for r in components.skill_synonyms(s).collect()}
    assert got == {"spark": ["PySpark", "spark", "SPARC"], "flink": ["Flink"]}


def test_source_pages_and_throttle(spark):
    pages = {"1": {"count": 4, "results": [{"id": "1", "title": "A", "company": {"display_name": "C"}}, {"id": "2"}]}, "2": {"results": [{"id": "3"}, {"id": "4"}]}}
    spark.dataSource.register(http.PostingsSource)
    raw = spark.read.format("postings").options(service="adzuna", fixture=json.dumps(pages)).load()
    got = http.normalize_records(raw).select("payload.*").orderBy("source_job_id").collect()
    assert [r["source_job_id"] for r in got] == ["1", "2", "3", "4"] and got[0]["company_raw"] == "C" and got[1]["company_raw"] is None
    usa = {"MatchedObjectDescriptor": {"PositionID": "9", "PositionSchedule": [], "PositionRemuneration": [{"MinimumRange": "5"}]}}
    r = http.normalize_records(spark.createDataFrame([("usajobs", json.dumps(usa))], "source string, raw_payload string")).select("payload.*").first()
    assert r["source_job_id"] == "9" and r["employment_type_raw"] is None and r["currency_raw"] == "USD"
    slept, now = [], [0.0]
    t = http.Throttle(2.5, lambda: now[0], slept.append)
    t()
    now[0] = 1.0
    t()
    assert slept == [1.5]
    with pytest.raises(ValueError):
        http.adzuna_request({"country": "xx"}, 1)


def test_stages_twice_equal_once(spark, tmp_path):
    pages = {"1": {"count": 2, "results": [{"id": str(i), "title": "T", "description": f"sql python {i}", "created": "2024-01-20T00:00:00Z"} for i in range(2)]}}
    cfg = stages.Config(root=f"file://{tmp_path}", country="us", run_ts=datetime(2024, 2, 1, tzinfo=UTC), run_id="r1", k_values=(2,))
    for want in ("done", "skipped"):
        assert [r["status"] for r in stages.run_data_pipeline(spark, cfg, options={"fixture": json.dumps(pages)})] == [want, "done"]
    assert spark.read.parquet(cfg.path("gold_fact_job_skills")).count() == 4
    assert stages.STAGES["feature"].run(spark, cfg)["metrics"]["jobs_embedded"] == 2
    with pytest.raises(FileNotFoundError):
        stages.STAGES["silver"].run(spark, stages.Config(root=f"file://{tmp_path}/none"))


def test_scans_and_sinks(spark, tmp_path):
    p = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, ingestion_date string")
    assert sinks.write_jsonl(df, f"{p}/j") == 2 and scans.path_exists(spark, f"{p}/j") and not scans.path_exists(spark, f"{p}/no")
    sinks.write_parquet(df, f"{p}/p", ("ingestion_date",))
    back = scans.scan(spark, f"{p}/p")
    assert [str(r[0]) for r in scans.list_partitions(back, "ingestion_date").collect()] == ["2024-01-01", "2024-01-02"]
    assert scans.read_ledger(spark, f"{p}/none").count() == 0
    assert scans.scan_window(df, None, datetime(2024, 1, 1), 3) is df


def test_late_files_and_pruned_dates(spark, tmp_path):
    path, ledger = f"file://{tmp_path}/in", f"file://{tmp_path}/ledger"
    rows = [(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2))]
    spark.createDataFrame(rows, "id int, day date").write.partitionBy("day").parquet(path)
    new = lambda: scans.new_partitions(spark, path, "day", scans.read_ledger(spark, ledger), "silver", "in")
    first = new()
    assert set(first) == {"2024-01-01", "2024-01-02"}
    scans.mark_partitions(spark, first, ledger, "silver", "in", F.lit("2024-02-01"))
    assert new() == {} and set(scans.new_partitions(spark, path, "day", scans.read_ledger(spark, ledger), "gold", "in")) == set(first)
    spark.createDataFrame([(3, rows[0][1])], "id int, day date").write.mode("append").partitionBy("day").parquet(path)
    late = new()
    df = scans.scan_dates(spark.read.parquet(path), "day", late)
    assert set(late) == {"2024-01-01"} and sorted(r["id"] for r in df.collect()) == [1, 3]
    assert "PartitionFilters: [" in df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert scans.scan_dates(spark.read.parquet(path), "day", {}).count() == 0


def test_keys_come_from_the_environment(monkeypatch):
    monkeypatch.setenv("ADZUNA_APP_ID", "an id")
    asked = {}
    class Stop(Exception):
        pass

    class Reader:
        def format(self, _):
            return self

        def options(self, **o):
            asked.update(o)
            raise Stop

    fake = type("Session", (), {"read": Reader(), "dataSource": type("Sources", (), {"register": lambda *_: None})()})()
    with pytest.raises(Stop):
        stages.bronze(fake, stages.Config(root="x", country="gb"))
    assert asked["app_id"] == "an id" and asked.get("app_key") == os.environ.get("ADZUNA_API_KEY")


def test_postings_of_two_dates_have_facts_once(spark):
    jobs = spark.createDataFrame([("a", "1", dt.date(2024, 1, 1)), ("a", "1", dt.date(2024, 1, 2)), ("a", "2", dt.date(2024, 1, 1))], "source string, job_id string, ingestion_date date")
    tags = jobs.crossJoin(spark.createDataFrame([("sql",)], "skills string"))
    got = sorted((r["job_id"], str(r["ingestion_date"])) for r in star.latest_tags(tags, jobs).collect())
    assert got == [("1", "2024-01-02"), ("2", "2024-01-01")]


def test_upsert_touches_few_buckets(spark, tmp_path):
    out, order = f"file://{tmp_path}/u", [F.desc_nulls_last("at")]
    rows = lambda *r: spark.createDataFrame(list(r), "id long, at long")
    sinks.upsert_parquet(rows(*((i, 1) for i in range(50))), out, ["id"], order, "1", 8)
    for _ in range(2):  # a version that is run again leaves what it left before
        folder = sinks.upsert_parquet(rows((7, 2), (7, 0)), out, ["id"], order, "2", 8)
        assert len(sinks._names(spark, folder)) == 2  # one bucket and the mark of success
        assert sorted(map(tuple, sinks.read_upserted(spark, out).collect())) == sorted((i, 2 if i == 7 else 1) for i in range(50))
    sinks.upsert_parquet(rows(), out, ["id"], order, "3", 8)
    assert sinks.read_upserted(spark, out).count() == 50
    with pytest.raises(ValueError):
        sinks.upsert_parquet(rows((1, 1)), out, ["id"], order, "4", 16)
    with pytest.raises(FileNotFoundError):
        sinks.read_upserted(spark, f"{out}/none")


def test_pairs_are_those_of_brute_force(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(60, 4))
    df = spark.createDataFrame([(f"k{i}", [float(c) for c in v]) for i, v in enumerate(x)] + [("none", None), ("zero", [0.0] * 4)], "id string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {tuple(sorted((f"k{i}", f"k{j}"))) for i in range(60) for j in range(i) if 1 - u[i] @ u[j] <= 0.3}
    for block in (4096, 9):
        monkeypatch.setattr(components, "BLOCK", block)
        got = [tuple(r) for r in components.similar_pairs(df, "id", "v", 0.3).collect()]
        assert len(got) == len(want) and set(got) == want


def test_components_of_chains(spark):
    n = 3000
    order = random.Random(3).sample(range(n), n)
    chain = [*zip(order, order[1:], strict=False), (n, n + 1), (0, 9999), (9999, n + 1), (5, 5), (None, n)]
    nodes = spark.createDataFrame([(i,) for i in range(n + 3)], "k long")
    got = components.connected_components(nodes, spark.createDataFrame(chain, "src long, dst long"), "k")
    assert dict(got.collect()) == dict.fromkeys(range(n), 0) | {n: n, n + 1: n, n + 2: n + 2}
    size = got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < 10**9  # an estimate that is a product of those of all rounds fills the driver


def test_similar_groups_make_few_links(spark, monkeypatch):
    import numpy as np

    rng, made, connect = np.random.default_rng(6), [], components.connected_components
    x = np.concatenate([rng.normal(size=(40, 6)), rng.normal(size=(1, 6)) + 0.01 * rng.normal(size=(60, 6)), np.repeat(rng.normal(size=(2, 6)), 50, axis=0)])
    x = x.astype("f4").astype("f8")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link, want = 1 - u @ u.T <= 0.2, np.arange(200)
    while (least := np.where(link, want, 200).min(axis=1)).tolist() != want.tolist():
        want = least
    odd = [(300, None), (301, [0.0] * 6), (302, [0.0] * 6), (303, [float("inf")] * 6), (304, [float("inf")] * 6), (None, u[0].tolist()), (0, u[0].tolist())]
    rows = [(i, v) for i, v in zip(range(200), x.tolist(), strict=True)] + odd
    monkeypatch.setattr(components, "connected_components", lambda nodes, links, key: made.append(links.count()) or connect(nodes, links, key))
    for kind in ("float", "double"):
        for block in (4096, 64):
            monkeypatch.setattr(components, "BLOCK", block)
            df = spark.createDataFrame(rows, f"position long, embedding array<{kind}>").withColumn("skills", F.concat(F.lit("S"), "position")).where("position IS NOT NULL")
            groups = components.skill_synonyms(df, 0.2).collect()
            got = {int(a[1:]): g["component"] for g in groups for a in g["aliases"]}
            assert got == dict(enumerate(want.tolist())) | {i: i for i in range(300, 305)}
    assert max(made) < 700 < int(link.sum() - 200) // 2  # a task's links are fewer than its vectors


def test_configuration_in_layers(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('query = "common"\nk_values = [2, 3]\n[env.dev]\nroot = "/dev-root"\nwindow_days = 7\n[env.prod]\nroot = "/prod"\n')
    cfg = settings.load_config(str(file), "dev", {"TESSERA_WINDOW_DAYS": "9", "TESSERA_LATEST_POSTINGS": "false"}, query=None, country="us", run_ts="2024-02-01")
    assert (cfg.root, cfg.window_days, cfg.query, cfg.country, cfg.k_values, cfg.latest_postings) == ("/dev-root", 9, "common", "us", (2, 3), False)
    assert cfg.run_ts == datetime(2024, 2, 1, tzinfo=UTC) and settings.load_config(str(file), "prod", {}).root == "/prod"
    for wrong in ({"env": "none"}, {"env": "dev", "colour": "red"}, {"env": "dev", "max_pages": "many"}, {}):
        with pytest.raises(ValueError):
            settings.load_config(str(file), wrong.pop("env", None), {}, **wrong)


def test_logs_carry_run_and_stage(tmp_path):
    file = tmp_path / "log"
    logs.configure(str(file), max_bytes=400, files=2)
    try:
        with logs.bound(run_id="r1", stage="silver"):
            for i in range(9):
                logging.getLogger("tessera").warning("%s rows", i)
            logging.getLogger("tessera.http").info({"status": "done"})
    finally:
        logs.configure()
    last = [json.loads(line) for line in file.read_text().splitlines()]
    assert last[-1]["status"] == "done" and all(r["run_id"] == "r1" and r["stage"] == "silver" for r in last)
    assert sorted(f.name for f in tmp_path.iterdir()) == ["log", "log.1", "log.2"]
