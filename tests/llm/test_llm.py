"""Each operator against a brute-force version on whole small tables, and on rows with nulls, ties, repeats, long texts and odd columns."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SF
from oracle import compare

from tessera.llm import bpe, common, components, decontaminate, licenses, minhash, packed, queries, secrets, separators, toolcalls, toxicity, vectors
from tessera.session import scratch_dir

SF2 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "ONE Two three four five six seven eight nine ten eleven"), (None, "no key"),
    (6, "tab\t x  y\n \nz é日本 İK ſ don't 's \x00 a   b"), (7, "x" * 50_000), (8, "word " * 30_000), (9, "token=abcdef123456 AKIA" + "A1" * 10 + " " + "0f" * 20),
]


def lower(t):
    return (t or "").translate(common.LOWER)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of all kinds, with columns that clash with results."""
    rows = [(i, t, "en", "s", 1, "x", 0.5, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, ids string, score double, cls int").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < 0")


def docs(spark, sf=SF2):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("sf", [SF, SF2])
def test_sql(spark, name, sf):
    compare(queries.QUERIES[name](spark, sf), queries.SQL[name], sf)


# 1 decontamination


def brute_hits(rows, items, size=10):
    win = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            win.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for k in {len(x) for x in win}:
            for i in range(len(w) - k + 1):
                if items_ := win.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= items_
        out.append((doc, len(w), len(hit), tuple(sorted(map(str, found)))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontaminate_edges(spark, odd, none, most):
    items = [(1, "one"), (2, None), (3, ""), (4, "Two, three"), (5, "TWO three four five six seven eight nine ten eleven twelve"), (None, "one"), (11, "word word"), (10, "k İ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(odd, bench, max_broadcast=most).collect()
    want = brute_hits([(i, t) for i, t in ODD], [x for x in items if x[0] is not None])
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=repr) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert decontaminate.decontaminate(none, bench, max_broadcast=most).count() == 0
    assert not any(r["n_hit"] for r in decontaminate.decontaminate(odd, bench.where("item_id < 0"), max_broadcast=most).collect())


def test_decontaminate_shuffled_equals_broadcast(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    a = decontaminate.decontaminate(docs(spark, SF), bench).collect()
    b = decontaminate.decontaminate(docs(spark, SF), bench, max_broadcast=0).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and any(r["contaminated"] for r in a)


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontaminate_documents_within_a_window(spark, most):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    w = text.split(" ")
    rows = [(k, " ".join(w[k:])) for k in range(len(w))] + [(20 + k, " ".join(w[: 7 - k % 2])) for k in range(20)] + [(40, f"see {text} there"), (41, " ".join(w[:10])), (42, " ".join(w[3:]) + " end")]
    items = [(1, text)]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_broadcast=most)
    want = brute_hits(rows, items)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()), key=repr) == want and sum(n > 0 for _, _, n, _ in want) == 4


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontaminate_item_id_with_several_texts(spark, most):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(14)) for _ in range(3)]
    items = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (2, texts[0])]
    rows = [(k, f"see {t} there") for k, t in enumerate(texts)] + [(5, texts[0] + " and " + texts[1]), (6, "none of them")]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_broadcast=most)
    want = brute_hits(rows, items)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()), key=repr) == want and [n for _, _, n, _ in want] == [14, 14, 14, 28, 0]


# 2 secrets


def brute_base(text):
    out = []
    for kind, pattern in (("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", re.compile("[0-9a-f]+"))):
        at = 0
        while m := pattern.search(text, at):
            size = len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24)
            if size:
                out.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
            at = m.end()
    return ",".join(x[2] for x in sorted(out))


def test_secrets(spark, odd, none):
    got = by_id(queries.QUERIES["op2_secret_scan"](spark, SF2))
    for r in docs(spark).collect():
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(brute_base(r["text"]).encode()).hexdigest()
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got.values()) > 0
    rows = secrets.scan_secrets(odd).collect()
    assert len(rows) == len(ODD) and {r["n_assign"] for r in rows if r["doc_id"] == 9} == {1}
    assert [r["redacted"] for r in rows if r["doc_id"] == 1] == [None]
    assert all("abcdef123456" not in (r["redacted"] or "") for r in rows)
    assert secrets.scan_secrets(none).count() == 0


def test_random_strings():
    enc = bpe.load_encoding()
    find = lambda t: [k for _, _, k in secrets.find_spans(t, lambda s: len(enc.encode_ordinary(s)))]
    assert find("key zX9kQ2vB7nM4pL8wR3tY6uJ1 end") == ["random"]
    for fine in ("InternationalizationConfigurationManager2", "550E8400-e29b-41d4-a716-446655440000", "D41D8CD98F00B204E9800998ECF8427E", "plain words"):
        assert find(fine) == []
    assert find("secret: zX9kQ2vB7nM4pL8wR3tY6uJ1") == ["assign"]
    for t in ("token=token=abcdef", "secret=token:abcdefgh", "API_KEY = 'x'", "ſecret=abcdefgh", "AKIAAKIA" + "A" * 14):
        assert secrets.render(secrets.base_spans(t)) == brute_base(t)


def test_random_strings_of_few_kinds():
    enc, rng = bpe.load_encoding(), random.Random(7)
    find = lambda t: secrets.find_spans(t, lambda s: len(enc.encode_ordinary(s)))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for kinds in (low + "0123456789", up + "234567", low + up):
        for _ in range(100):
            s = "".join(rng.choice(kinds) for _ in range(40))
            spans = find(f"see {s} here")
            assert [k for _, _, k in spans] == ["random"] and secrets.redact(f"see {s} here", spans) == "see [SECRET] here"
    for fine in ("donaudampfschifffahrtsgesellschaft", "internationalization_configuration", "=" * 60, "550e8400-e29b-41d4-a716-446655440000", "D41D8CD98F00B204E9800998ECF8427E"):
        assert find(fine) == []


def test_random_spans_against_brute_force(spark):
    """Every candidate by its own pattern search, its exclusions, and the library's tokens, on whole texts with planted strings."""
    enc, rng = bpe.load_encoding(), random.Random(9)
    texts = [r["text"] for r in docs(spark, SF).collect()] + [t for _, t in ODD if t]
    planted = ["".join(rng.choice("abcdefghijkLMNOPQRSTUVWXYZ0123456789+/_=-") for _ in range(rng.randrange(15, 60))) for _ in range(60)]
    texts += [f"token={p} and {p}, key: {q}" for p, q in itertools.pairwise(planted)]
    n = 0
    for t in texts:
        base = secrets.base_spans(t)
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t):
            known = re.fullmatch(r"[0-9a-fA-F]+", m[0]) and len(m[0]) in (32, 40, 56, 64, 96, 128) or re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", m[0])
            free = not any(set(range(a, b)) & set(range(*m.span())) for a, b, _ in base) if len(m[0]) >= 20 and not known else False
            if free and len(m[0]) / len(enc.encode_ordinary(m[0])) < 2.2:
                want.append((*m.span(), "random"))
        assert secrets.random_spans(t, lambda s: len(enc.encode_ordinary(s)), base) == want
        n += len(want)
    assert n > 30


# 3 byte-level BPE


def test_bpe(spark, odd, none):
    enc = bpe.load_encoding()
    got = by_id(queries.QUERIES["op3_byte_bpe"](spark, SF2))
    for r in docs(spark).collect():
        ids = enc.encode_ordinary(r["text"])
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    rows = bpe.encode_texts(odd).collect()
    assert sorted(repr((r["doc_id"], r["ids"])) for r in rows) == sorted(repr((i, " ".join(map(str, enc.encode_ordinary(t or ""))))) for i, t in ODD)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows)
    assert bpe.encode_texts(none).count() == 0


def test_bpe_appends_and_edits():
    rng, enc = random.Random(1), bpe.load_encoding()
    one = bpe.PrefixBPE(bpe.load_ranks())
    for _ in range(60):
        data = bytes(rng.choice(b"thean oring-_=0123\xc3\xa9") for _ in range(rng.randrange(0, 400)))
        buf = bpe.Buffer(one, data[:50])
        buf.append(data[50:])
        a = rng.randrange(len(data) + 1)
        b = rng.randrange(a, min(len(data), a + 9) + 1)
        new = bytes(rng.choice(b"thean ") for _ in range(rng.randrange(6)))
        buf.replace(a, b, new)
        want = data[:a] + new + data[b:]
        assert buf.data == want and buf.ids() == enc._encode_single_piece(want) if want else buf.ids() == []
    pieces = [bytes(rng.choice(b"thean orings") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    assert bpe.batch_bpe(bpe.DEFAULT_RANKS).encode(pieces) == [enc._encode_single_piece(p) for p in pieces]


def test_pairs_against_plain_merging():
    rng, one = random.Random(3), bpe.PrefixBPE(bpe.load_ranks())
    for most in (300, 3000, 50_000):
        for _ in range(700):
            a, b = rng.randrange(most), rng.randrange(most)
            assert one.is_pair(a, b) == (one.merge(one.tokens[a] + one.tokens[b]) == [a, b])


# 4 vectors


def brute_vectors(rows, threshold=0.95):
    good, x = vectors.units([v for _, v in rows])
    ids = [i for (i, _), g in zip(rows, good, strict=True) if g]
    near = x @ x.T >= threshold
    return set(ids), {(a, b) for k, a in enumerate(ids) for m, b in enumerate(ids) if k != m and near[k, m]}


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 64))
    rows = [(int(i), (base[i % 60] + 0.15 * rng.standard_normal(64) * (i >= 60)).tolist()) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(40)] + [(700, None), (701, []), (702, [0.0] * 64), (703, [float("nan")] * 64), (704, [None] * 64), (705, [1.0, 2.0])]
    rows += [(706, [x * 3 for x in rows[7][1]])]
    df = spark.createDataFrame([(i, v, "x", 9) for i, v in rows], "vec_id long, embedding array<double>, v string, n_links int").repartition(4)
    got = by_id(vectors.near_vectors(df), "vec_id")
    ids, links = brute_vectors([r for r in rows if r[0] != 705])
    assert set(got) == {i for i, _ in rows}
    found = sum(r["n_links"] for r in got.values())
    assert 0.99 * len(links) <= found <= len(links)
    assert got[700]["n_links"] == got[702]["n_links"] == got[705]["n_links"] == 0 and got[703]["kept"]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert vectors.near_vectors(df.where("vec_id < 0")).count() == 0
    assert vectors.near_vectors(df.where("vec_id = 702")).collect()[0]["component_id"] == 702


def test_vectors_of_several_lengths(spark):
    rng, rows = np.random.default_rng(6), []
    for dim, n in ((64, 400), (96, 300), (24, 60), (8, 2)):
        base = rng.standard_normal((n // 2, dim))
        rows += [(len(rows) + k, (base[k % (n // 2)] + 0.1 * rng.standard_normal(dim) * (k >= n // 2)).tolist()) for k in range(n)]
    rows += [(5000, rng.standard_normal(1000).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = by_id(vectors.near_vectors(df), "vec_id")
    assert set(got) == {i for i, _ in rows} and got[5000]["n_links"] == 0
    for dim in (64, 96, 24, 8):
        ids, links = brute_vectors([r for r in rows if len(r[1]) == dim])
        found = sum(got[i]["n_links"] for i in ids)
        assert links and 0.95 * len(links) <= found <= len(links)
    one = [r for r in rows if len(r[1]) == 64] + rows[-1:]
    found = sum(r["n_links"] for r in vectors.near_vectors(spark.createDataFrame(one, "vec_id long, embedding array<double>")).collect())
    assert found >= 0.95 * len(brute_vectors(one[:-1])[1]) > 0


def dense(seed, n_near, n_random, noise=0.1, dim=64):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(dim)
    return [centre + noise * rng.standard_normal(dim) for _ in range(n_near)] + [rng.standard_normal(dim) for _ in range(n_random)]


CASES = {
    "one near group alone": dense(1, 300, 0), "with few others": dense(2, 300, 30), "with as many others": dense(3, 300, 300),
    "with a longer vector": dense(4, 300, 300) + dense(5, 0, 1, dim=128), "scaled copies": [dense(6, 1, 0)[0] * k for k in (1, 2, 3, 0.5, 1e-3)],
    "huge and tiny": [dense(7, 1, 0)[0] * k for k in (1e200, 1, 1e-200)], "around the threshold": dense(8, 400, 300, 0.23),
    "chain": list(np.cumsum(np.random.default_rng(9).standard_normal((300, 64)), 0)), "two numbers": dense(10, 60, 60, 0.3, 2), "one number": dense(11, 9, 0, 0.1, 1),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_vector_recall(spark, case):
    rows = [(i, v.tolist()) for i, v in enumerate(CASES[case])]
    got = by_id(vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)), "vec_id")
    want = dict.fromkeys(got, 0)
    links = set()
    for dim in {len(v) for _, v in rows}:
        links |= brute_vectors([r for r in rows if len(r[1]) == dim])[1]
    for a, _ in links:
        want[a] += 1
    assert 0.97 * len(links) <= sum(r["n_links"] for r in got.values()) and all(got[i]["n_links"] <= n for i, n in want.items())
    label = {i: r["component_id"] for i, r in got.items()}
    assert all(label[a] == label[b] for a, b in links) or case in ("around the threshold", "chain") and sum(label[a] == label[b] for a, b in links) >= 0.97 * len(links)


def test_vectors_of_the_tables_with_planted_copies(spark):
    """One dominant near group, copies at all distances, and the ids divisible by 100 against all rows."""
    rng = np.random.default_rng(12)
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    size = max(i for i, _ in rows) + 1
    planted = [(size + k, v + s * np.linalg.norm(v) / 8 * rng.standard_normal(64)) for k, ((_, v), s) in enumerate((r, rng.uniform(0, 0.5)) for r in rows[:600])]
    hot = [(2 * size + k, rows[0][1] * rng.uniform(0.5, 2) + 0.05 * rng.standard_normal(64)) for k in range(1000)]
    all_ = [(i, v.tolist()) for i, v in rows + planted + hot]
    got = by_id(vectors.near_vectors(spark.createDataFrame(all_, "vec_id long, embedding array<double>").repartition(4)), "vec_id")
    ids, links = brute_vectors(all_)
    asked = sum(a % 100 == 0 for a, _ in links)
    assert len(got) == len(all_) and asked > 50
    assert 0.97 * asked <= sum(r["n_links"] for i, r in got.items() if i % 100 == 0) <= asked
    assert 0.97 * len(links) <= sum(r["n_links"] for r in got.values()) <= len(links)


def test_vectors_that_share_a_vec_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.02, 1.0]), (None, [1.0, 0.0]), (4, [-1.0, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r["vec_id"])
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_rotations_balance():
    x = np.random.default_rng(0).standard_normal((2000, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    r = vectors.learn_rotation(x - x.mean(0), 32, 0)
    assert np.allclose(r.T @ r, np.eye(32), atol=1e-8) and abs(((x - x.mean(0)) @ r >= 0).mean(0) - 0.5).max() < 0.1


# 5 MinHash


def brute_documents(rows, size=2, percent=80):
    sets = []
    for _, t in rows:
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", lower(t))]
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    seen = set()
    for members in index.values():
        for a, b in itertools.combinations(members, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(rows[a][0]), root(rows[b][0])
                    up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True)}


def test_minhash_on_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()]
    got = by_id(queries.QUERIES["op5_minhash_dedup"](spark, SF2))
    want = brute_documents(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert sum(not r["kept"] for r in got.values()) > 20


@pytest.mark.parametrize("small", [24, 3])
def test_minhash_chains_and_groups(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "LEADERS", 0 if small == 3 else 3)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for g in range(6):
        w = [word() for _ in range(120)]
        for k in range(25):  # each copy changes a few words of the one before: a chain whose ends differ
            w = list(w)
            for _ in range(1 + g):
                w[rng.randrange(120)] = word()
            rows.append((1000 * g + k, " ".join(w)))
    rows += [(9000 + i, rows[3][1].upper()) for i in range(50)] + [(9900, ""), (9901, None), (9902, "One"), (9903, "one "), (9904, "\x1cone\xa0")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, cls int").repartition(4)
    got = by_id(minhash.near_documents(df, size=2))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_documents(rows)


def test_minhash_edges(spark, odd, none):
    got = minhash.near_documents(odd).collect()
    assert len(got) == len(ODD) and sum(r["kept"] for r in got if r["doc_id"] == 4) == 2
    assert minhash.near_documents(none).count() == 0


def test_long_words_and_repeated_sets(spark):
    """Words that a weak hash confuses, texts of one set in different orders, and very long words."""
    low, up = "a" * 5000, list("a" * 5000)
    up[0], up[4096] = "d", "\x60"
    a, b = [f"w{k}" for k in range(50)], "x" * 100_000
    rows = [(1, low), (2, "".join(up)), (3, " ".join(a + a)), (4, " ".join(a + a + a)), (5, " ".join([*a[25:], *a, *a[:25]])), (6, b), (7, b + "y"), (8, b.upper())]
    got = by_id(minhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), size=2))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_documents(rows)
    words = [bytes(random.Random(5).choices(b"abc \t", k=5000)), b"q" * 70 + b" " + b"q" * 64 + b" z", b"", b" \n "]
    for w in words:
        starts, h = minhash.word_hashes(w)
        assert [w[s:].split()[0] for s in starts] == w.split() and len(set(h.tolist())) == len(set(w.split()))


def test_bayes_bounds():
    assert [minhash.least_matches(n) for n in (30, 150)] == sorted(minhash.least_matches(n) for n in (30, 150))
    rng = np.random.default_rng(1)
    a = rng.integers(0, 9, (500, 150))
    b = np.where(rng.random((500, 150)) < 0.8, a, -1)
    assert len(minhash.survivors(a, b)) == 500 and len(minhash.survivors(a, np.where(rng.random((500, 150)) < 0.4, a, -1))) == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


# 6 and 10 token files


def whole(texts, special=True):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = not special
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packed(spark, odd, none):
    rows = sorted((r["doc_id"], r["text"]) for r in docs(spark).collect())
    got, start = by_id(queries.QUERIES["op6_packed_tokens"](spark, SF2)), 0
    for (i, _), ids in zip(rows, whole([t for _, t in rows]), strict=True):
        ids = [*ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd_rows = sorted(((i, t or "") for i, t in ODD), key=lambda r: (r[0] is not None, r))
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in packed.op6_token_files(odd).collect()))
    sizes = [len(x) + 1 for x in whole([t for _, t in odd_rows])]
    assert got == [(sum(sizes[:k]), i, sizes[k]) for k, (i, _) in enumerate(odd_rows)]
    assert packed.op6_token_files(none).count() == 0


def test_words_equal_the_tokenizer():
    from tessera.llm.words import WordEncoder

    texts = [t or "" for _, t in ODD[:8]] + ["<|endoftext|> a<|startoftext|>b", "Été İstanbul é ́x ẞ ǅ ﬁ", "a.b... c!? d's 12x", "ΑΣ ΑΣ. Σ", "İ. ẞ! aͅb"]
    for special in (True, False):
        enc = WordEncoder(special=special)
        assert [np.frombuffer(b, "<u4").tolist() for b in enc(texts)] == whole(texts, special)


def test_pack_bits(tmp_path):
    rng = np.random.default_rng(2)
    for width in (1, 7, 16, 17, 31, 32):
        v = rng.integers(0, 1 << width, 1000, dtype=np.uint64)
        data = packed.pack(v, width)
        assert (packed.unpack(data, width, 1000) == v).all() and (packed.unpack(data, width, 100, 777) == v[777:877]).all()
    w = packed.Writer(f"file://{tmp_path}/x.bin", 17)
    for i in range(9):
        w.add(i, np.arange(i * 10, dtype="<u4").tobytes())
    w.add(None, b"")
    w.close()
    r = packed.Reader(f"file://{tmp_path}/x.bin")
    assert r.document(0, 7).tolist() == list(range(70)) and r.block(0)[0] == [*range(9), None]


def test_files_are_read_by_many_tasks_and_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "FILES", 1)
    d = docs(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        manifest = packed.write_packed(d.union(d.withColumn("doc_id", d.doc_id * 0 + 5)).repartition(9), f"file://{tmp_path}/packed")
        files = manifest.count()
        assert files > 1
        tasks = separators.spread(manifest, files, "part").rdd.getNumPartitions()
        assert tasks == min(7, files) and packed.read_packed(manifest).count() == 2 * d.count()
        places = separators.write_flat(d, f"file://{tmp_path}/flat")
        assert separators.search_blocks(separators.flat_sizes(places), 9, 2, 1 << 12).rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    shared = "/" + scratch_dir(spark).removeprefix("file:").lstrip("/")
    for op in ("op4_embedding_dedup", "op5_minhash_dedup", "op6_packed_tokens", "op8_tool_calls", "op10_token_counts"):
        old = set(os.listdir(shared))
        rows = queries.QUERIES[op](spark, SF)
        assert len(set(os.listdir(shared)) - old) == 1 and rows.count() > 0


def test_counts(spark, odd, none, tmp_path, monkeypatch):
    rows = docs(spark, SF).collect()
    got = by_id(queries.QUERIES["op10_token_counts"](spark, SF))
    assert {i: r["n_tokens"] for i, r in got.items()} == dict(zip((r["doc_id"] for r in rows), map(len, whole([r["text"] for r in rows], False)), strict=True))
    assert separators.op10_token_counts(odd).count() == len(ODD) and separators.op10_token_counts(none).count() == 0
    rng = random.Random(4)
    for size, chunk in ((2, 1024), (2, 3), (6, 2), (10, 1), (1 << 20, 1024)):
        monkeypatch.setattr(separators, "CHUNK", chunk)
        ids = [rng.choice([7, 7, 7, 9]) for _ in range(101)]
        ids[-1] = 7 if size != 6 else 9
        path = tmp_path / f"f{size}.bin"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        (tmp_path / "empty.bin").write_bytes(b"")
        files = separators.flat_files(spark, [f"file://{path}", f"file://{tmp_path}/empty.bin"])
        found = sorted((r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in separators.count_tokens(files, 9, 2, size).collect())
        want, at = [], 0
        for k, i in enumerate(ids):
            if i == 9:
                want.append((len(want), at, k - at, True))
                at = k + 1
        if at < len(ids):
            want.append((len(want), at, len(ids) - at, False))
        assert found == want


# 7 licenses


def test_licenses(spark, odd, none):
    got = by_id(queries.QUERIES["op7_license_scan"](spark, SF2))
    for r in docs(spark).collect():
        w = WORD.findall(lower(r["text"]))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert 0 <= g["score"] <= 1 and labels <= set(g["labels"].split(","))
    assert sum(g["n_base"] for g in got.values()) > 0
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(none).count() == 0


def test_expressions():
    assert licenses.parse_expression("MIT OR (Apache-2.0 AND GPL-2.0+ with Classpath-exception-2.0)") == ["MIT", "Apache-2.0", "GPL-2.0+", "Classpath-exception-2.0", "WITH", "AND", "OR"]
    assert licenses.parse_expression("MIT */ something") == ["MIT"]
    post = licenses.parse_expression("MIT AND Apache-2.0 OR GPL-3.0")
    assert licenses.evaluate(post, {"GPL-3.0"}.__contains__) and not licenses.evaluate(post, {"MIT"}.__contains__)
    for bad in ("", "OR MIT", "()", ")"):
        with pytest.raises(licenses.ExpressionError):
            licenses.parse_expression(bad)
    found = licenses.scan_text("# SPDX-License-Identifier: MIT OR Apache-2.0\nMIT License, MIT LICENSE")
    assert found[1] == 2 and found[4] == "mit" and found[5] == "apache,expression-permitted,mit" and found[7] == "MIT Apache-2.0 OR"


def test_outcomes_and_long_texts():
    either, both = (licenses.scan_text(f"SPDX-License-Identifier: MIT {op} GPL-3.0-only") for op in ("OR", "AND"))
    assert either[8] is True and both[8] is False and either[5] == "expression-permitted,gpl,mit" and both[5] == "expression-restricted,gpl,mit"
    assert licenses.scan_text("SPDX-License-Identifier: MIT WITH x\nSPDX-License-Identifier: GPL-2.0")[8] is False and licenses.scan_text("MIT License")[8] is None
    assert licenses.scan_text("SPDX-License-Identifier: GPL-2.0", frozenset(["gpl-2.0"]))[8] is True
    import time

    began = time.time()
    assert licenses.scan_text("MIT License, " * 200_000)[:4] == (400_000, 200_000, 0, 399_998)
    assert licenses.parse_expression("MIT OR " * 100_000 + "x")[-1] == "OR" and licenses.scan_text("SPDX-License-Identifier: " + "(" * 400_000)[7] == ""
    assert time.time() - began < 20


# 8 tool calls


def test_tool_calls(spark):
    calls = [
        (1, "a", 1, "add", '{"y": 2, "x": 1.5}', None), (1, "b", 2, "add", '{"x": "1", "z": 0, "y": 3}', "a"), (1, "c", 3, "add", "[1]", "b"), (1, "d", 4, "no", "{}", "zz"),
        (2, "a", 1, "add", None, "b"), (2, "b", 2, "add", '{"x":1,"y":2}', "a"), (2, "b", 2, "add", '{"x":1,"y":2}', "a"), (None, None, 0, "add", "{}", None), (3, None, 0, None, "{}", None),
    ]
    results = [(1, "a", "3\"é\n"), (1, "a", "4"), (1, "x", None), (2, "b", None), (None, None, "?")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, needs string")
    r = spark.createDataFrame(results, "conv_id long, call_id string, content string")
    schema = {"add": {"x": ("number", True), "y": ("integer", True), "t": ("string", False)}}
    out = toolcalls.link_calls(c, r, schema).collect()
    got = {(x["conv_id"], x["call_id"]): x for x in out if x["conv_id"] in (1, 2) and x["call_id"]}
    assert got[1, "a"]["message"] == '{"arguments":{"x":1.5,"y":2},"content":"3\\"é\\n","id":"a","name":"add"}' and got[1, "a"]["n_results"] == 2
    assert got[1, "a"]["errors"] == "" and got[1, "b"]["errors"] == "type:x,unknown:z" and got[1, "c"]["errors"] == "not_an_object" and got[1, "d"]["errors"] == "unknown_tool"
    assert [got[1, k]["wave"] for k in "abcd"] == [0, 1, 2, 0] and [got[1, k]["position"] for k in "abcd"] == [1, 3, 4, 2]
    assert got[2, "a"]["wave"] is None and got[2, "b"]["n_calls"] == 2 and got[2, "a"]["errors"] == "not_an_object"
    assert got[1, "x"]["status"] == "no_call" and got[2, "b"]["status"] == "linked" and got[1, "b"]["status"] == "no_result"
    assert len(out) == 10
    assert toolcalls.link_calls(c.where("turn > 9"), r.where("conv_id > 9"), schema).count() == 0


def test_waves_of_long_chains_and_cycles(spark):
    chain = [(1, f"c{i}", i, f"c{i - 1}" if i else None) for i in range(150)]
    loop = [(2, "a", 0, "c"), (2, "b", 1, "a"), (2, "c", 2, "b"), (2, "tail", 3, "a"), (2, "self", 4, "self"), (2, "free", 5, "gone"), (2, "next", 6, "free")]
    star = [(3, "hub", 9, None), *((3, f"s{i:03}", i % 7, "hub") for i in range(200))]
    links = spark.createDataFrame([(c, i, t, n if n is None else [n]) for c, i, t, n in [*chain, *loop, *star]], "conv_id long, call_id string, turn long, needs array<string>")
    got = {(r["conv_id"], r["call_id"]): (r["wave"], r["position"]) for r in toolcalls.positions(toolcalls.waves(links)).collect()}
    ranked = [(3, k) for _, k in sorted((t, k) for _, k, t, _ in star[1:])]
    want = {(1, f"c{i}"): (i, i + 1) for i in range(150)} | {(2, "free"): (0, 1), (2, "next"): (1, 2), (3, "hub"): (0, 1)}
    assert got == want | {k: (1, i + 2) for i, k in enumerate(ranked)}


def test_waves_of_graphs(spark):
    """Random graphs of calls with several needs, ladders, and a cycle beside them, against a plain topological order."""
    rng, rows = random.Random(8), []
    for conv in range(4):
        for i in range(60):
            rows.append((conv, f"n{i}", i, sorted({f"n{rng.randrange(max(0, i - (3, 9, 60, 2)[conv]), i)}" for _ in range(rng.randrange(4))}) if i else None))
    rows += [(9, "a", 0, ["b", "n"]), (9, "b", 1, ["c"]), (9, "c", 2, ["a", "free"]), (9, "free", 3, ["gone", None]), (9, "late", 4, ["free", "c"]), (9, "n", 5, []), (9, "m", 6, ["n", "free"])]
    rows += [(10, f"n{i}", i, [f"n{j}" for j in (i - 1, i - 2) if j >= 0]) for i in range(40)]
    want: dict = {}
    for _ in rows:
        for c, i, _, needs in rows:
            there = [n for n in needs or () if any((c, n) == r[:2] for r in rows)]
            if all((c, n) in want for n in there):
                want[c, i] = max((want[c, n] + 1 for n in there), default=0)
    links = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, needs array<string>")
    assert {(r["conv_id"], r["call_id"]): r["wave"] for r in toolcalls.waves(links).collect()} == want


def test_tool_calls_from_odd_turns(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "user", None), (None, 0, "user", "x"), (2, None, "user", "y"), (3, 0, None, None), (4, 5, "assistant", "late" * 9000)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, wave int")
    rows = toolcalls.op8_tool_calls(df).collect()
    others = [(r["conv_id"], r["turn"], r["message"]) for r in rows if r["status"] == "other"]
    assert sorted(others, key=repr) == [(2, None, '{"content":"y","role":"user"}'), (3, 0, '{"content":null,"role":null}'), (None, 0, '{"content":"x","role":"user"}')]
    got = {(r["conv_id"], r["call_id"]): r for r in rows if r["status"] != "other"}
    assert set(got) == {(1, "1:0"), (1, "1:2"), (4, "4:4")}
    assert got[1, "1:0"]["n_calls"] == 2 and got[1, "1:2"]["errors"] == "missing:prompt" and got[1, "1:2"]["wave"] == 1


# 9 toxicity


def test_toxicity(spark, odd, none):
    got = by_id(queries.QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1"))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(got[i]["score"], y, got[i]["predicted"]) for i, y in labels.items() if got[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    pos, neg = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert auc > 0.95 and sum(p == y for _, y, p in held) / len(held) > 0.95
    labelled = spark.createDataFrame([(5, 1, 1), (4, None, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    for lab in (labelled, labelled.where("doc_id < 0")):
        rows = toxicity.op9_toxicity(odd, lab).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.op9_toxicity(none, labelled).count() == 0


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.2).astype(int)
    acc = [0.95, 0.9, 0.9, 0.85, 0.85, 0.8, 0.75, 0.7, 0.95, 0.9]  # voters that vote on half of the rows, whatever their label
    votes = np.stack([np.where(rng.random(3000) < 0.5, np.where(rng.random(3000) < a, 2 * y - 1, 1 - 2 * y), 0) for a in acc], 1)
    noisy = np.where(rng.random(3000) < 0.1, 1 - y, y)
    some = np.where(rng.random(3000) < 0.3, noisy, -1)
    right = lambda v, g: ((toxicity.label_model(v, g) > 0.5) == y).mean()
    assert right(votes, some) > 0.96 and right(votes, np.full(3000, -1)) > 0.95  # by agreement alone, too
    one = np.where(rng.random(3000) < 0.3, 2 * (rng.random(3000) < 0.5).astype(int) - 1, 0)[:, None]
    assert right(np.hstack([votes, np.repeat(one, 9, 1)]), some) > 0.95  # nine voters that are one, and tell nothing


def test_scores_against_brute_force(spark):
    """Scores from the model's weights, counted text by text, with long words and other columns."""
    from collections import Counter

    d = docs(spark, "/root/testdata/sf0.1")
    model = toxicity.fit(d, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    extra = [(-1, "idiot" * 30 + " IDIOT trash " + "q" * 90_000), (-2, None), (-3, "")]
    some = docs(spark).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] or "" for r in some.collect()}
    got = by_id(toxicity.score_texts(some, model, keep_text=False))
    k = len(model.terms)
    for i, t in text.items():
        words = re.findall(r"[^\W\d_]+", t.lower())
        counts = Counter(x for w in words for x in [w + ".", *(w[:n] + "-" for n in (5, 7) if len(w) >= n)])
        z = model.weights[-1] + sum(
            model.weights[j] * np.log1p(counts[x]) + model.weights[k + j] * 10 * counts[x] / (max(len(words), 1) + 10) + model.weights[2 * k + j] for x, j in model.terms.items() if counts[x]
        )
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    assert model.terms and "idiot." in model.terms
