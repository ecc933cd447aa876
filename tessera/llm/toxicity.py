"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model over their votes, a linear classifier on its
posterior labels.

Voters vote toxic, clean or not at all: words of a small lexicon, words and first letters of words that labelled rows suggest, patterns of
abuse and shouting, and the absence of all such words. The label model learns, over labelled and unlabelled rows, how often each
voter votes either way under either label, and which voters agree beyond what the label explains. It starts from the voters' majority; a
gold label, where a row has one, is one more voter, whose accuracy is learned like the others'. The classifier sees how often each term stands
in a text and how dense it is there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, map_rows, scope, store, struct

#: The bounds of the samples, the rows of least hash: labelled ones, from which terms and a gold voter come, and others, whose labels are
#: not read. More rows add nothing that a linear model of at most VOTERS terms could use. Every text is scored.
MAX_LABELLED, MAX_UNLABELLED = 8000, 4000
VOTERS = 200
STEMS = (5, 7)
LEVELS = (1, 2, 3)
MIN_DOCS = 5
MIN_GAIN = 12.0  # in log-likelihood, of a mined voter: beyond what chance gives the best of some hundred thousand terms
GOLD_PRIOR, GOLD_ROWS = 0.9, 50  # the accuracy that a gold label is first taken to have, and how many rows that guess weighs
WORD = re.compile(r"[^\W\d_]+")
#: Words of abuse, each a voter wherever it stands.
LEXICON = (
    "idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "jerk", "garbage", "filth",
    "imbecile", "hate", "ugly", "kill", "shut", "vermin", "coward", "liar", "freak", "creep", "idiota", "dummkopf", "connard", "imbécile", "estúpido",
)
#: Patterns of abuse and shouting, each a voter.
PATTERNS = {
    "starred": re.compile(r"\w\*{2,}\w"), "shout": re.compile(r"!{3,}|\?!{2,}"), "drawn": re.compile(r"([^\W\d_])\1{4,}"),
    "capitals": re.compile(r"(?:\b[A-Z]{3,}\b\W+){4,}"), "you": re.compile(r"\byou(?: are|'re)? (?:an? |such an? |so )?(?:" + "|".join(LEXICON) + r")\b", re.IGNORECASE),
}


def held_out(doc_id: str = "doc_id"):  # noqa: ANN201
    """Rows from whose labels nothing is learned; a null doc_id, which no label has, is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms_of(word: str) -> list[str]:
    """The word (with a full stop as its mark) and its stems (with a hyphen)."""
    return [word + ".", *(word[:n] + "-" for n in STEMS if len(word) >= n)]


def count_terms(text: str) -> tuple[Counter, int]:
    words = Counter(WORD.findall(text.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        for t in terms_of(w):
            out[t] += n
    return out, sum(words.values())


@dataclass(frozen=True)
class Model:
    """What scoring needs: terms with their places in the weights, and the weights of counts, densities and bias."""

    terms: dict[str, int]
    weights: list[float]

    def features(self, counts: dict[int, int], n_words: int) -> dict[int, float]:
        k, size = len(self.terms), max(n_words, 1)
        out = {}
        for i, n in counts.items():
            out[i] = float(np.log1p(n))
            out[k + i] = 10.0 * n / (size + 10)
            out[2 * k + i] = 1.0
        return out

    def score(self, counts: dict[int, int], n_words: int) -> float:
        z = self.weights[-1] + sum(self.weights[i] * x for i, x in self.features(counts, n_words).items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sampled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """(doc_id, text, gold: 1, 0 or null) of the rows that may be learned from, chosen by hash and so alike at every run: labelled ones, and
    others as if they had no label. A doc_id with several texts or labels counts once, with the least text and the higher label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    gold = known.orderBy(*order).limit(max_labelled).select("doc_id", (F.col("toxic") == 1).cast("int").alias("gold"))
    other = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*order).limit(max_unlabelled).join(gold, "doc_id", "left_anti")
    ids = gold.unionByName(other.select("doc_id", F.lit(None).cast("int").alias("gold")))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # as many ids as the two bounds allow at most
    return rows.groupBy("doc_id", "gold").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def mine_terms(sample: DataFrame) -> DataFrame:
    """(term, level, toxic documents, clean documents) over the labelled sample: counted over some rows in Python, summed by Spark."""

    def make() -> Callable[[list[dict]], list[tuple]]:
        def some(rows: list[dict]) -> list[tuple]:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for r in rows:
                counts = seen[r["gold"]]
                for t, n in count_terms(r["text"])[0].items():
                    for k in LEVELS[:n]:
                        counts[t, k] += 1
            return [(t, k, seen[1][t, k], seen[0][t, k]) for t, k in seen[0].keys() | seen[1].keys()]

        return some

    seen = map_batches(sample, make, struct("term string, level int, toxic long, clean long"), mb=0.5)
    return seen.groupBy("term", "level").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_voters(mined: DataFrame, n_toxic: int, n_clean: int, voters: int = VOTERS) -> list[tuple[str, int]]:
    """The terms and levels that tell most: by the gain in log-likelihood of one rate for toxic and one for clean documents over one for all."""
    n, t, c = n_toxic + n_clean, F.col("toxic"), F.col("clean")
    p, q, r = (t + 0.5) / (n_toxic + 1.0), (c + 0.5) / (n_clean + 1.0), (t + c + 0.5) / (n + 1.0)
    gain = t * F.log(p / r) + c * F.log(q / r) + (n_toxic - t) * F.log((1 - p) / (1 - r)) + (n_clean - c) * F.log((1 - q) / (1 - r))
    good = mined.where((t + c >= MIN_DOCS) & (p > q)).withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN)
    return [(x["term"], x["level"]) for x in good.orderBy(F.desc("gain"), "term", "level").limit(voters).collect()]


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior that each row is toxic. votes: rows x voters of 1 (toxic), -1 (clean) and 0 (no vote); gold: 1, 0 or -1 (none).

    Expectation-maximisation of each voter's rates of either vote under either label, and of the gold labels' rates, from the voters'
    majority on; the prior is the gold labels' share of toxic ones, drawn towards the majority's. A voter whose votes agree with others' beyond what the labels explain counts as one of a group. Under toxic a voter's
    toxic votes are no rarer than under clean, and the other way round, so the labels can't change places."""
    n, m = votes.shape
    kinds = [(votes == v).astype(float) for v in (1, -1)]
    post = np.where((votes > 0).sum(1) > (votes < 0).sum(1), 0.9, 0.1)
    discount = np.ones(m)
    known = gold >= 0  # the prior stays: if it moved with the posteriors, rows on which few vote would draw it to either end
    prior = ((gold == 1).sum() + 20 * post.mean()) / (known.sum() + 20)
    for step in range(rounds):
        on, off = ([(k.T @ y + 0.5) / (y.sum() + 1.5) for k in kinds] for y in (post, 1 - post))
        if step % 10 == 0 and m > 1:  # correlations of what the labels leave unexplained
            rest = votes - post[:, None] * (on[0] - on[1]) - (1 - post)[:, None] * (off[0] - off[1])
            size = np.sqrt((rest**2).sum(0)) + 1e-9
            together = np.clip(rest.T @ rest / np.outer(size, size), 0, 1)
            discount = 1 / np.where(together > 0.3, together, 0).sum(1).clip(1)
        say = [np.log(a / b) for a, b in zip(on, off, strict=True)]
        say = np.maximum(say[0], 0), np.minimum(say[1], 0)  # who does not vote says nothing
        z = np.log(prior / (1 - prior)) + sum(k @ (s * discount) for k, s in zip(kinds, say, strict=True))
        for label, sign in ((1, 1), (0, -1)):
            has = gold == label
            right = ((post if label else 1 - post)[has].sum() + GOLD_PRIOR * GOLD_ROWS) / ((post if label else 1 - post)[gold >= 0].sum() + GOLD_ROWS)
            wrong = ((1 - post if label else post)[has].sum() + (1 - GOLD_PRIOR) * GOLD_ROWS) / ((1 - post if label else post)[gold >= 0].sum() + GOLD_ROWS)
            z = z + has * sign * max(0.0, float(np.log(right / wrong)))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return post


def vote(counts: np.ndarray, voters: list[tuple[int, int]], found: np.ndarray) -> np.ndarray:
    """rows x voters of 1, -1 and 0. counts: rows x terms; voters: (term, level); found: rows x patterns of 0 and 1. The last voter votes
    clean where no other votes toxic."""
    toxic = [counts[:, t] >= k for t, k in voters] + [found[:, i] > 0 for i in range(found.shape[1])]
    toxic = np.stack(toxic, 1).astype(int) if toxic else np.zeros((len(counts), 0), int)
    return np.hstack([toxic, -(toxic.sum(1, keepdims=True) == 0).astype(int)])


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last column is the bias and is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + shrink * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learns from at most max_labelled labelled rows and max_unlabelled others, of which only the counts of the chosen terms come to the
    driver. Without a toxic or without a clean label there is nothing to learn and every score is that of the prior."""
    with scope(docs.sparkSession):
        sample = store(sampled(docs, labels, max_labelled, max_unlabelled), "sample")
        n_toxic, n = sample.agg(F.count_if(F.col("gold") == 1), F.count("gold")).first()
        if not n_toxic or n_toxic == n:
            return Model({}, [4.0 if n_toxic else -4.0])
        own = [(w + ".", 1) for w in LEXICON]
        mined = choose_voters(mine_terms(sample.where("gold IS NOT NULL")), n_toxic, n - n_toxic)
        voters = list(dict.fromkeys(own + mined))
        terms = {t: i for i, t in enumerate(dict.fromkeys(t for t, _ in voters))}
        model = Model(terms, [])

        def make() -> Callable[[dict], Iterator[tuple]]:
            def one(row: dict) -> Iterator[tuple]:
                counts, size = count_terms(row["text"])
                has = sorted((terms[t], n) for t, n in counts.items() if t in terms)
                marks = [int(p.search(row["text"]) is not None) for p in PATTERNS.values()]
                yield row["doc_id"], row["gold"], size, [i for i, _ in has], [n for _, n in has], marks

            return one

        counted = struct("gold int, size long, at ints, n ints, marks ints")
        rows = map_rows(sample, make, type(counted)([sample.schema["doc_id"], *counted])).orderBy("doc_id").collect()
    k = len(terms)
    counts = np.zeros((len(rows), k))
    for i, r in enumerate(rows):
        counts[i, r["at"]] = r["n"]
    votes = vote(counts, [(terms[t], level) for t, level in voters], np.array([r["marks"] for r in rows]))
    soft = label_model(votes, np.array([-1 if r["gold"] is None else r["gold"] for r in rows]))
    x = np.zeros((len(rows), 3 * k + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        for j, v in model.features(dict(zip(r["at"], r["n"], strict=True)), r["size"]).items():
            x[i, j] = v
    return Model(terms, fit_linear(x, soft).tolist())


RESULT = struct("score double, predicted int")


def score_texts(df: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df's columns (those that the result has, in any case of letters, give way), score and predicted. One row for each row, repeated ones
    too; a null text is scored as an empty one; texts and words of any length are read whole; an empty table gives none."""
    keep = [c for c in df.columns if c.lower() not in ("score", "predicted") and (keep_text or c != text)]
    schema = type(RESULT)([*(df.schema[c] for c in keep), *RESULT])
    read = list(dict.fromkeys([*keep, text]))

    def make() -> Callable[[dict], Iterator[tuple]]:
        exact = {t[:-1]: i for t, i in model.terms.items() if t[-1] == "."}
        stems = {n: {t[:-1]: i for t, i in model.terms.items() if t[-1] == "-" and len(t) == n + 1} for n in STEMS}

        def one(row: dict) -> Iterator[tuple]:
            words = WORD.findall((row[text] or "").lower())
            counts: dict[int, int] = {}
            for keys, table in [(words, exact), *(([w[:n] for w in words], stems[n]) for n in STEMS)]:
                if table:
                    for w in filter(table.__contains__, keys):
                        counts[table[w]] = counts.get(table[w], 0) + 1
            s = model.score(counts, len(words))
            yield (*(row[c] for c in keep), s, int(s >= 0.5))

        return one

    return map_rows(df.select(*read), make, schema)


def op9_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the two tables and scores every document: doc_id, held_out (false for a null doc_id), score, predicted; see score_texts. Labels
    without documents, null ones and repeated ones (the higher counts) do no harm, and without any the score is that of the prior."""
    scored = score_texts(documents.select("doc_id", "text"), fit(documents, labels), keep_text=False)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
