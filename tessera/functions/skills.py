"""Dictionary tagging as native array expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
SKILLS = (
    "python", "pyspark", "spark", "sql", "aws", "gcp", "bigquery", "airflow", "docker", "kubernetes", "nlp", "spacy", "pandas",
    "tensorflow", "mlflow",
)
SYNONYMS = {"py spark": "pyspark", "google cloud": "gcp", "amazon web services": "aws"}
BASE_CONFIDENCE, STEP, MOST = 0.5, 0.2, 0.95


def _words(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def extract_skills(tokens: Column, dictionary: Sequence[str] = SKILLS) -> Column:
    """Distinct tokens that the dictionary has, in order of first occurrence; empty for null."""
    return F.coalesce(F.array_intersect(tokens, _words(dictionary)), _words(()))


def normalize_skills(skills: Column, synonyms: Mapping[str, str] = SYNONYMS) -> Column:
    """Each skill through the synonyms, then distinct; empty for null."""
    if not synonyms:
        return F.coalesce(F.array_distinct(skills), _words(()))
    table = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))
    mapped = F.transform(skills, lambda s: F.coalesce(F.try_element_at(table, s), s))
    return F.coalesce(F.array_distinct(mapped), _words(()))


def occurrences(tokens: Column, skill: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t == skill))


def confidence(count: Column) -> Column:
    """min(0.5 + 0.2 n, 0.95), kept as the double that a float32 widens to."""
    return F.least(F.lit(BASE_CONFIDENCE) + count * F.lit(STEP), F.lit(MOST)).cast("float").cast("double")


def skill_confidence(tokens: Column, skills: Column) -> Column:
    """Map from each skill to its confidence."""
    return F.map_from_arrays(skills, F.transform(skills, lambda s: confidence(occurrences(tokens, s))))


def ngram_tokens(tokens: Column, n: int = 3) -> Column:
    """tokens and all runs of 2 to n of them joined by a space, so that synonyms of several words can match."""
    size = F.size(tokens)
    runs = [tokens]
    for k in range(2, n + 1):
        starts = F.when(size >= k, F.sequence(F.lit(1), size - (k - 1))).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, _joined(tokens, k)))
    return F.concat(*runs)


def _joined(tokens: Column, k: int) -> Callable[[Column], Column]:
    return lambda i: F.array_join(F.slice(tokens, i, k), " ")
