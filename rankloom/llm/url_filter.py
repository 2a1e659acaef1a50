"""URL rules by hashed expressions.

A rule is a host, a path and an action.  It fits the host and all its
subdomains where the URL's path starts with the rule's path.  Each URL is
expanded into expressions, every suffix of its host with every beginning of its
path that is as long as some rule's path.  Expressions and rules meet in an
equi-join on the first digits of a digest; the full digest confirms, and the
longest rule wins.  The rules are broadcast while their measured size allows
it; more rules become a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import lower_ascii
from rankloom.operators.sizing import broadcast_if_small

SHORT = 8
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (host, path, action) with digests.  Null parts count as empty; a rule without an action is left out."""
    text = F.concat(lower_ascii(F.col("host")), F.coalesce("path", F.lit("")))
    digest = F.sha2(text, 256)
    return (
        rules.where(F.col("action").isNotNull())
        .select(
            text.alias("_rule"),
            F.char_length(F.coalesce("path", F.lit(""))).alias("_path_length"),
            F.col("action").alias("_action"),
            digest.alias("_digest"),
            F.left(digest, F.lit(SHORT)).alias("_short"),
        )
        .distinct()
    )


def judge(urls: DataFrame, url: str, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """All rows and columns of ``urls`` with host, path, rule and verdict.

    Rules of equal length: the longer host first, then the greater action
    (``block`` before ``allow``).  A URL that no rule fits, also a null or
    empty one, has no rule and the verdict ``otherwise``.  A column called like
    an output is replaced.  Equal rows stay apart.
    """
    hashed = hashed_rules(rules)
    lengths = sorted(r[0] for r in hashed.select("_path_length").distinct().collect())  # one number a length
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = urls.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row") if kept else F.lit(None).alias("_row"),
        F.monotonically_increasing_id().alias("_id"),
        url_host(F.col(f"`{url}`")).alias("_host"),
        url_path(F.col(f"`{url}`")).alias("_path"),
    ).withColumn("_labels", F.split("_host", r"\."))
    suffix = F.posexplode(F.expr("transform(sequence(1, size(_labels)), i -> array_join(slice(_labels, i, size(_labels)), '.'))"))
    hosts = parts.select("_row", "_id", "_host", "_path", suffix.alias("_at", "_suffix"))
    start = F.explode(F.array(*[F.lit(k) for k in lengths or [0]]))
    spots = hosts.select("*", start.alias("_k")).where((F.char_length("_path") >= F.col("_k")) | (F.col("_at") == 0))
    spots = spots.withColumn("_full", F.sha2(F.concat("_suffix", F.substring("_path", F.lit(1), F.col("_k"))), 256))
    fits = (F.left("_full", F.lit(SHORT)) == F.col("_short")) & (F.col("_full") == F.col("_digest")) & (F.char_length("_path") >= F.col("_k"))
    found = spots.join(broadcast_if_small(hashed), fits & (F.col("_k") == F.col("_path_length")), "left")
    found = found.where(F.col("_rule").isNotNull() | (F.col("_at") == 0))
    choice = F.struct(F.char_length("_rule").alias("n"), F.char_length("_suffix").alias("h"), "_action", "_rule")
    rows = found.groupBy("_id").agg(
        F.first("_row", ignorenulls=True).alias("_row"),
        F.first("_host").alias("host"),
        F.first("_path").alias("path"),
        F.max(F.when(F.col("_rule").isNotNull(), choice)).alias("_best"),
    )
    return rows.select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        "host",
        "path",
        F.col("_best._rule").alias("rule"),
        F.coalesce("_best._action", F.lit(otherwise)).alias("verdict"),
    )
