"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key-like characters with a digit, and values
assigned to a name such as ``token``.  A forest trained from labelled findings
judges each by its length, its character transitions (under the letter pairs
of the corpus's words), how much of it the corpus's frequent words cover, its
path and the words beside it.

Word and pair counts cover all documents; what reaches the driver is the list
of the most frequent words, whose length is a parameter, and a table of letter
pairs.  The forest is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import python_workers
from rankloom.operators.chunks import written_once

#: most frequent words that make the dictionary
DICTIONARY = 5_000
#: labelled rows that the forest is fitted on, those with the least hashes
MOST_LABELLED = 20_000
TREES, DEPTH, SEED = 40, 8, 7

# fixed values: words beside a secret and beside something that only looks like one
SECRET_WORDS = frozenset("userinfo begin token secret password passwd pwd apikey api_key key access_key private_key auth bearer credential credentials".split())
PLAIN_WORDS = frozenset("sha sha1 sha256 md5 commit checksum digest hash uuid guid id phone tel card isbn serial order version date".split())
TEST_PATHS = frozenset("test tests testing example examples sample samples mock fixture fixtures demo doc docs".split())

#: a run of key-like characters with a digit, and the name it is assigned to
CANDIDATE = re.compile(
    r"(?:(?<![A-Za-z0-9_\-])(?P<name>[A-Za-z][A-Za-z0-9_\-]*+)[\"']?[ \t]*+(?::=|[=:])[ \t]*+)?(?P<quote>[\"'`]?)(?P<value>(?<![A-Za-z0-9+/_=.\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+(?:\.[A-Za-z0-9+/_\-]{16,}+)*+={0,2})"
)
ASSIGNMENT = re.compile(r"(?<![A-Za-z0-9_\-])(?P<name>[A-Za-z0-9_\-]++)[\"']?[ \t]*+(?::=|[=:])[ \t]*+(?P<quote>[\"'`]?)")
SECRET_NAME = re.compile(r"(?i)(?:token|secret|passwo?r?d|pwd|api_?-?key|access_?key|private_?key)$")
ASSIGNED_VALUE = re.compile(r"[^\s\"'`]{6,}")
#: a password between user and host of an address
USERINFO = re.compile(r"(?i)://[^\s/:@\"'<>]++:(?P<value>[^\s/:@\"'<>]{4,}+)@")
NEIGHBOURS = 3
AROUND = 1_000
WORD = re.compile(r"[A-Za-z0-9_]+")

FEATURES = [
    "size", "digits", "upper", "hex", "switches", "distinct", "entropy", "pair_score", "covered", "quoted", "assigned",
    "named_secret", "named_plain", "near_secret", "near_plain", "near_numbers", "path_test", "path_depth",
]
FOUND = "start long, length long, name string, value string, " + ", ".join(f"{f} double" for f in FEATURES)


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) of all words of three to twenty letters a-z, in lower case, over all documents."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit("[a-z]{3,20}"), F.lit(0))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def frequent_words(counted: DataFrame, most: int = DICTIONARY) -> frozenset[str]:
    return frozenset(r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect())


def pair_scores(counted: DataFrame) -> dict[str, float]:
    """Logarithm of the share of each pair of letters (at most 676) in all words, by their number."""
    pair = F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))"))
    rows = counted.select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    return {r["pair"]: math.log(r["n"] / total) for r in rows}


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the letters that dictionary words cover, the longest word first from the left."""
    low, covered, letters = value.lower(), 0, sum(c.isalpha() for c in value)
    at = 0
    while at < len(low) and letters:
        size = next((k for k in range(min(20, len(low) - at), 2, -1) if low[at : at + k] in words), 0)
        covered += size
        at += size or 1
    return covered / letters if letters else 0.0


def kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3


def path_features(path: str) -> tuple[float, float]:
    parts = [p for p in re.split(r"[/\\.]+", path.lower()) if p]
    return float(any(p in TEST_PATHS for p in parts)), float(len(parts))


def describe(value: str, name: str, quote: str, before: str, after: str, path: str, words: frozenset[str], pairs: dict[str, float]) -> list[float]:
    n, low = len(value), value.lower()
    kinds = [kind_of(c) for c in value]
    seen = [pairs.get(low[i : i + 2], -12.0) for i in range(n - 1) if low[i : i + 2].isalpha()]
    near = [w.lower() for w in [*WORD.findall(before)[-NEIGHBOURS:], *WORD.findall(after)[:NEIGHBOURS]]]
    named = set(re.split(r"[_\-]", name.lower())) | {name.lower()}
    return [
        float(n),
        kinds.count(0) / n,
        kinds.count(1) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        len(set(value)) / n,
        -sum(k / n * math.log2(k / n) for k in Counter(value).values()),
        sum(seen) / len(seen) if seen else -12.0,
        coverage(value, words),
        float(bool(quote)),
        float(bool(name)),
        float(bool(named & SECRET_WORDS)),
        float(bool(named & PLAIN_WORDS)),
        float(sum(w in SECRET_WORDS for w in near)),
        float(sum(w in PLAIN_WORDS for w in near)),
        float(sum(w.isdigit() for w in near)),
        *path_features(path),
    ]


def find_in(text: str) -> list[tuple[int, str, str, str]]:
    """(start, value, name, quote) of the candidates of a text, in order and without overlaps."""
    found = {}
    for m in ASSIGNMENT.finditer(text):
        if SECRET_NAME.search(m["name"]) and (v := ASSIGNED_VALUE.match(text, m.end())):
            found.setdefault(v.start(), (v.start(), v[0], m["name"], m["quote"]))
    for m in CANDIDATE.finditer(text):
        found.setdefault(m.start("value"), (m.start("value"), m["value"], m["name"] or "", m["quote"] or ""))
    for m in USERINFO.finditer(text):
        found.setdefault(m.start("value"), (m.start("value"), m["value"], "userinfo", ""))
    out, end = [], -1
    for item in sorted(found.values(), key=lambda f: (f[0], -len(f[1]))):
        if item[0] >= end:
            out.append(item)
            end = item[0] + len(item[1])
    return out


#: frequent words and pair scores
Words = tuple[frozenset[str], dict[str, float]]


def corpus_words(docs: DataFrame, text: str) -> Words:
    """The most frequent words and the scores of letter pairs, counted over all documents."""
    counted = written_once(vocabulary(docs, text), "vocabulary")
    return frequent_words(counted), pair_scores(counted)


def candidates(docs: DataFrame, key: str, text: str, path: str | None, known: Words, keep: Sequence[str] = ()) -> DataFrame:
    """One row per candidate: id, start and length in code points, name, value, its features, and the columns ``keep``.

    Null texts have none; a missing path counts as empty.  Repeated rows give
    repeated candidates.
    """
    python_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        (F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")).alias("path"),
        *[F.col(f"`{c}`") for c in keep],
    )
    kind = dict(rows.dtypes)["id"]
    names = ["id", *(c.split()[0] for c in FOUND.split(", "))]
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[3:])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, scores = sent.value
        for batch in batches:
            at, found = [], []
            for i in range(batch.num_rows):
                whole = batch.column(1)[i].as_py()
                for start, value, name, quote in find_in(whole):
                    end = start + len(value)
                    features = describe(
                        value, name, quote, whole[max(0, start - AROUND) : start], whole[end : end + AROUND], batch.column(2)[i].as_py(), dictionary, scores
                    )
                    at.append(i)
                    found.append((start, len(value), name, value, *features))
            columns = list(zip(*found)) or [()] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.float64()] * len(FEATURES)]
            rows_ = pa.array(at, pa.int64())
            more = [c.take(rows_) for c in batch.columns[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_), *map(pa.array, columns, kinds), *more], [*names, *keep])

    return rows.mapInArrow(work, f"id {kind}, {FOUND}{kept}")


def fit_forest(labelled: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A forest from candidates with ``label`` 0 or 1 (other labels are left out).

    Of each label the ``most`` distinct values with the least hashes take part,
    so copies of one finding count once and a rare label is never crowded out.
    Without both labels there is nothing to learn, which is an error.
    """
    rows = labelled.where(F.col("label").isin(0, 1)).withColumn("_h", F.xxhash64("value"))
    one = rows.groupBy("label", "value").agg(F.min(F.struct("_h", *FEATURES)).alias("r")).select("label", "value", "r.*")
    parts = [one.where(F.col("label") == n).orderBy("_h", "value").limit(most) for n in (0, 1)]
    rows = parts[0].unionByName(parts[1]).select(*FEATURES, F.col("label").cast("double").alias("label"))
    rows = written_once(rows, "labelled")
    if rows.select("label").distinct().count() < 2:
        raise ValueError("findings of both labels are needed")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", cacheNodeIds=False).fit(rows)


def judge(found: DataFrame, forest: Model, threshold: float = 0.5) -> DataFrame:
    """Candidates with ``probability`` and ``secret``."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(found)
    rows = forest.copy({forest.featuresCol: "_features"}).transform(rows)
    rows = rows.withColumn("probability", F.round(vector_to_array("probability")[1], 9))
    return rows.withColumn("secret", F.col("probability") >= threshold).select(*found.columns, "probability", "secret")


def redact(text: str | None, spans: Sequence[tuple[int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each span (start, length) replaced; spans do not overlap."""
    if text is None:
        return None
    parts, at = [], 0
    for start, length in sorted(spans):
        parts += (text[at:start], mark)
        at = start + length
    return "".join([*parts, text[at:]])


def stored_candidates(docs: DataFrame, key: str, text: str, path: str | None, known: Words) -> DataFrame:
    """Candidates of all documents, stored once for training and judging."""
    return written_once(candidates(docs, key, text, path, known), "candidates")
