"""The pipeline's stages against brute force, on a small table and on rows without a doc_id, with a shared one, and with copies."""

from __future__ import annotations

import hashlib
import os
import random

import corpus_pipeline as C
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm import brute_documents, brute_hits

from tessera.llm import bpe, secrets

RNG = random.Random(11)


def prose(n=60):
    return " ".join("".join(RNG.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def near(text):
    w = text.split(" ")
    w[len(w) // 2] = "changed"
    return " ".join(w)


def fingerprint(text):
    return "" if text is None else hashlib.sha256(text.encode()).hexdigest()


def rows():
    a, b, c, d, e, f = (prose() for _ in range(6))
    return [
        (None, prose()), (None, prose()), (None, a), (None, near(a)), (None, b), (3, near(b)), (1, c), (1, d), (1, d), (2, near(d)), (0, near(c)),
        (7, e), (7, near(e)), (7, prose()), (5, f), (5, None), (5, ""), (6, None), (None, None), (None, ""), (None, None),
    ]


@pytest.fixture(scope="module")
def table(spark):
    made = [(i, t, "en", "s", len(t or "")) for i, t in rows()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select(*odd.columns).where("doc_id % 4 = 1").unionByName(odd).repartition(3).cache()


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_copies(spark, table):
    order = lambda r: (r[0] is None, r[0] or 0, fingerprint(r[1]))
    all_ = sorted(set(pairs(table)), key=order)
    found = brute_documents([(k, t) for k, (_, t) in enumerate(all_)], size=5)
    got = pairs(C.without_near_copies(spark, table, SF))
    assert got == sorted((r for k, r in enumerate(all_) if found[k][1] == k), key=repr)
    assert sum(i is None and bool(t) for i, t in got) == 3 and {(5, None), (5, ""), (None, None), (None, "")} <= set(got)


def test_benchmark_secrets_and_tokens(spark, table):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    table = table.union(table.where("doc_id = 7").select(F.lit(None).cast("long"), F.concat("text", F.lit(" " + max(t for _, t in items))), "lang", "source", "n_chars"))
    all_ = pairs(table)
    clean = [r for r in all_ if not brute_hits([r], items)[0][2]]
    assert pairs(C.without_benchmark(spark, table, SF)) == clean and len(clean) < len(all_)
    enc = bpe.load_encoding()
    safe = [(i, t if t is None else secrets.redact(t, secrets.find_spans(t, lambda s: len(enc.encode_ordinary(s))))) for i, t in all_]
    told = C.without_secrets(spark, table, SF)
    assert pairs(told) == sorted(safe, key=repr) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in told.collect())
    got = C.as_tokens(spark, table, SF).collect()
    want = [(i, " ".join(map(str, enc.encode_ordinary(t or "")))) for i, t in all_]
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=repr) == sorted(want, key=repr) and all(r["round_trip"] for r in got)


def test_all_stages_keep_rows_without_an_id(spark, table, tmp_path):
    for name in ("labels", "benchmark"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = C.run(spark, str(tmp_path))
    kept = [r for r in pairs(C.without_toxic(spark, table, SF)) if r[0] is None]
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    assert len({t for _, t in kept}) >= got.where("doc_id IS NULL").count() > 1


NAMES = {"score": "x", "Predicted": 1, "spans": "y", "n_tokens": 2, "redacted": "z", "_kept": 3, "_print": 4, "fingerprint": "f", "none": 5, "print": 6, "row": 7, "ids": 8}


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_with_clashing_columns_and_no_rows(spark, table, name):
    """Columns of any name stay as they are, repeated rows and nulls pass, and an empty table gives none."""
    more = table.where("doc_id IS NULL OR doc_id < 30").withColumns({n: F.lit(v) for n, v in NAMES.items()}).withColumn("n_words", F.hash("doc_id", "text"))
    stage = dict(C.STAGES)[name]
    got, plain = stage(spark, more, SF), stage(spark, more.select(*table.columns), SF)
    assert pairs(plain.withColumn("text", F.col("ids") if name == "tokens" else F.col("text"))) == pairs(got.withColumn("text", F.col("ids") if name == "tokens" else F.col("text")))
    if name != "tokens":
        assert got.columns == more.columns and plain.columns == table.columns
        assert got.where(" OR ".join(f"`{n}` <> '{v}'" for n, v in NAMES.items())).isEmpty()
        if name != "secrets":
            assert got.where("n_words <> hash(doc_id, text)").isEmpty()
    assert stage(spark, more.where("doc_id < -1"), SF).count() == 0


def test_pipeline_against_brute_force(spark):
    """All stages over a whole table, each recomputed in plain Python from what the one before it kept."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = C.toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = []
    for r in docs.collect():
        counts, size = C.toxicity.count_terms(r["text"] or "")
        if model.score({model.terms[t]: n for t, n in counts.items() if t in model.terms}, size) < 0.5:
            rows.append((r["doc_id"], r["text"]))
    assert 0.7 * docs.count() < len(rows) < docs.count()
    found = brute_documents(rows, size=5)
    rows = [r for r in rows if found[r[0]][1] == r[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, _, n, _ in brute_hits(rows, items) if not n}
    enc = bpe.load_encoding()
    want = []
    for i, t in rows:
        if i in clean:
            t = secrets.redact(t, secrets.find_spans(t, lambda s: len(enc.encode_ordinary(s))))
            want.append((i, " ".join(map(str, enc.encode_ordinary(t)))))
    got = C.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted(want) and all(r["round_trip"] for r in got)
