"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: likelihoods of hashed byte trigrams under a model for each language,
  trained on the declared languages of all rows.
* Declared markup language: how often a declaration is made on texts of each
  language, estimated from all rows.
* Address suffix and host: how often each language occurs under the suffix, the
  domain and the host, by grouped aggregation; each level is smoothed with the
  one above, and a row does not count for itself.

The posterior is their normalised product.  Every declared code is a language,
at most 26^2 + 26^3 of them.  Models are trained and sent in blocks of
languages; the tables of hosts and declarations are joined, broadcast only
while their measured size allows it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import digest_of, free_name, join_rows, lower_ascii, python_workers
from rankloom.operators.chunks import written_once
from rankloom.operators.sizing import broadcast_if_small

#: hash buckets of a model; one more holds blank trigrams
WIDTH = 1 << 14
#: trigrams of a text overlap, so each counts for a part only
TEMPER = 1 / 3
#: rows that a level of addresses weighs against what lies below
STRENGTH = 10.0
#: languages trained, sent and summed together; any number of blocks
LANGUAGE_BLOCK = 256
#: bytes worked on at a time
BATCH_BYTES = 4_000_000

GAP = b"   "
LETTERS = np.array([b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def text_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, trigram buckets, first trigram of each row) of bounded size; a single text may exceed it."""
    for batch in batches:
        lengths = np.asarray([len(t.as_py() or "") for t in batch.column(column)]) + 1
        groups = np.cumsum(lengths) // BATCH_BYTES
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                rows = batch.slice(a, b - a)
                parts = [(t or "").lower().encode("utf-8", "replace") for t in rows.column(column).to_pylist()]
                yield rows, *trigrams(parts)


def trigrams(parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts, each with blanks around it, and where each text begins."""
    raw = LETTERS[np.frombuffer(GAP[:2] + GAP.join(parts) + GAP, np.uint8)].astype(np.uint32)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - WIDTH.bit_length() + 1)
    bucket[code == 0x202020] = WIDTH
    starts = np.concatenate([[0], np.cumsum([len(p) + len(GAP) for p in parts])[:-1]])
    return bucket.astype(np.int64), starts.astype(np.int64)


def code_of(declared: Column) -> Column:
    """``en`` of ``EN-us``; null where there is no such code."""
    code = F.regexp_extract(lower_ascii(declared), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)
    return F.when(code != "", code)


def declared_in(html: Column) -> Column:
    """The language that the markup of a page declares."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3}\b)""", 1)


def train(rows: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """Log-likelihoods (language, bucket) from all rows (declared, text) with a language; 0 for blank trigrams."""
    number = {code: i for i, code in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for part, bucket, starts in text_batches(batches, 1):
            ends = np.append(starts[1:], len(bucket))
            of = np.array([number.get(d, -1) for d in part.column(0).to_pylist()])
            which = np.repeat(of, ends - starts)
            for i in set(of.tolist()) - {-1}:
                found = np.bincount(bucket[which == i], minlength=WIDTH + 1)
                seen[i] = seen.get(i, 0) + found
        for i, found in seen.items():
            used = np.flatnonzero(found)
            used = used[used < WIDTH]
            yield pa.RecordBatch.from_pydict({"i": np.full(len(used), i), "bucket": used, "n": found[used]})

    counted = rows.select("declared", "text").where(F.col("declared").isin(list(languages)))
    sums = counted.mapInArrow(count, "i long, bucket long, n long").groupBy("i", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), WIDTH + 1), 0.5)
    np.add.at(table, (sums["i"].to_numpy(), sums["bucket"].to_numpy()), sums["n"].to_numpy())
    model = np.log(table / table[:, :WIDTH].sum(axis=1, keepdims=True))
    model[:, WIDTH] = 0
    return model.astype(np.float32)


def train_blocks(rows: DataFrame, languages: Sequence[str]) -> Iterator[np.ndarray]:
    """The models of all languages, one block after the other."""
    for at in range(0, len(languages), LANGUAGE_BLOCK):
        yield train(rows, languages[at : at + LANGUAGE_BLOCK])


def score(rows: DataFrame, models: Iterable[np.ndarray]) -> DataFrame:
    """``rows`` without the text, with ``_grams`` (trigrams that are not blank), ``_text`` (tempered
    log-likelihood of each language) and ``_share`` (the same as probabilities)."""
    sent = [rows.sparkSession.sparkContext.broadcast(model) for model in models]
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bucket, starts in text_batches(batches, len(kept)):
            sums = np.stack([np.add.reduceat(level[bucket].astype(np.float64), starts) for table in sent for level in table.value], axis=1)
            grams = np.add.reduceat((bucket < WIDTH).astype(np.int64), starts)
            sums *= TEMPER
            share = np.exp(sums - sums.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            at = np.arange(len(starts) + 1, dtype=np.int32) * sums.shape[1]
            lists = [pa.ListArray.from_arrays(at, x.ravel()) for x in (sums, share)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(grams), *lists], [*kept, "_grams", "_text", "_share"])

    return rows.select(*kept, "text").mapInArrow(work, f"{schema}, _grams long, _text array<double>, _share array<double>")


def summed(df: DataFrame, keys: Sequence[str], column: str, n: int, rows: Column | str = "_n") -> DataFrame:
    """Element-wise sums of an array of ``n`` numbers, and of ``rows`` as ``_n``."""
    if n > LANGUAGE_BLOCK:  # too many for one expression each
        parts = df.select(*keys, F.col(rows).alias("_n") if isinstance(rows, str) else rows.alias("_n"), F.posexplode(column).alias("_at", "_x"))
        parts = parts.groupBy(*keys, "_at").agg(F.sum("_x").alias("_x"), F.sum("_n").alias("_n"))
        parts = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_all_at"), F.max("_n").alias("_n"))
        return parts.select(*keys, F.transform("_all_at", lambda p: p["_x"]).alias(column), "_n")
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.col(column)[i]) for i in range(n)]).alias(column), F.sum(rows).alias("_n"))


def smoothed(counts: Column, total: Column, above: Column) -> Column:
    """Shares of the counts, drawn towards those of the level above."""
    return F.zip_with(counts, above, lambda c, p: (c + STRENGTH * p) / (total + STRENGTH))


def host_priors(scored: DataFrame, n: int) -> DataFrame:
    """(host, counts, prior of the domain): what a row of the host needs to get its own prior."""
    hosts = summed(scored, ["host"], "_share", n, F.lit(1))
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn(
        "suffix", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise("")
    )
    domains = summed(hosts, ["suffix", "domain"], "_share", n)
    suffixes = summed(domains, ["suffix"], "_share", n).withColumn("_all", F.lit(1))
    whole = summed(suffixes, ["_all"], "_share", n)
    even = F.array_repeat(F.lit(1.0 / n), n)
    prior = lambda above: smoothed(F.col("_share"), F.col("_n"), above)
    suffixes = suffixes.join(F.broadcast(whole.select("_all", prior(even).alias("_top"))), "_all")
    domains = domains.join(suffixes.select("suffix", prior(F.col("_top")).alias("_above")), "suffix")
    domains = domains.select("suffix", "domain", prior(F.col("_above")).alias("_domain_prior"))
    return hosts.join(domains, ["suffix", "domain"]).select("host", F.col("_share").alias("_host"), "_n", "_domain_prior")


def declaration_weights(scored: DataFrame, n: int) -> DataFrame:
    """(declared, log P(declared | language) for each of the ``n`` languages): one row a language."""
    rows = summed(scored.where(F.col("declared").isNotNull()), ["declared"], "_share", n, F.lit(1))
    rows = written_once(rows.withColumn("_all", F.lit(1)), "declarations")
    whole = summed(rows, ["_all"], "_share", n).select("_all", F.col("_share").alias("_whole"))
    logs = F.zip_with("_share", "_whole", lambda c, t: F.log((c + 0.5) / (t + 0.5 * n)))
    return rows.join(F.broadcast(whole), "_all").select("declared", logs.alias("_declares"))


def identify(rows: DataFrame, least: float = 0.5, wanted: Sequence[str] | None = None) -> DataFrame:
    """``rows`` (declared, host, text and any others) without the text; with lang, posterior and kept.

    A row is rejected (``kept`` false) if its text has no letters, if no
    language has a posterior of ``least``, or if the language is not among
    ``wanted`` (default: all that are declared somewhere).  A null or empty text gets its language
    from the other evidence; a missing declaration or host gives none.  Without
    any declared language nothing can be told: lang is null and all rows are
    rejected.  Other columns may have any name; one called lang, posterior or
    kept is left out, as the output takes its place.  Rows are kept apart and in
    no order.
    """
    python_workers(rows.sparkSession)
    others = [c for c in rows.columns if c not in ("declared", "host", "text") and c.lower() not in ("lang", "posterior", "kept")]
    carried = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("_"))
    others = [F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(others)]
    rows = rows.select(
        carried.alias("_row"), code_of(F.col("declared")).alias("declared"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text")
    )
    languages = sorted(r["declared"] for r in rows.where("declared is not null").select("declared").distinct().collect())
    if not languages:
        return rows.select(*others, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    n = len(languages)
    scored = written_once(score(rows, train_blocks(rows, languages)), "languages")
    hosts = broadcast_if_small(host_priors(scored, n))
    own = F.zip_with("_host", "_share", lambda c, s: F.greatest(c - s, F.lit(0.0)))
    fused = (
        scored.join(hosts, "host", "left")
        .join(broadcast_if_small(declaration_weights(scored, n)), "declared", "left")
        .withColumn("_prior", F.when(F.col("host") != "", smoothed(own, F.col("_n") - 1, F.col("_domain_prior"))).otherwise(F.col("_domain_prior")))
    )
    none = F.array_repeat(F.lit(0.0), n)
    logs = F.zip_with(
        F.zip_with("_text", "_prior", lambda t, p: t + F.log(p)), F.coalesce("_declares", none), lambda a, b: a + b
    )
    fused = fused.withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    lang = F.get(F.array(*[F.lit(c) for c in languages]), F.array_position("_logs", F.col("_top")).cast("int") - 1)
    total = F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    fused = fused.withColumn("lang", lang).withColumn("posterior", 1 / total)
    kept = (F.col("_grams") > 0) & (F.col("posterior") >= least)
    if wanted is not None:
        kept = kept & F.col("lang").isin(list(wanted))
    return fused.select(*others, "lang", "posterior", kept.alias("kept"))


def keep_identified(docs: DataFrame, key: str, declared: str, host: str, text: str, by_row: bool = False) -> DataFrame:
    """Rows of ``docs`` that are not rejected, all columns.

    With ``by_row`` each row is judged by its own text, declaration and host.
    Otherwise rows that share a key (null counts as a value) are judged
    together: all go if one is rejected.
    """
    name = free_name(docs.columns, "_digest")
    marked = docs.withColumn(name, digest_of(*[F.col(f"`{c}`") for c in (declared, host, text)]))
    rows = marked.select(
        F.col(f"`{key}`").alias("_key"), F.col(name).alias("_digest"), F.col(f"`{declared}`").alias("declared"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")
    )
    gone = identify(rows).where(~F.col("kept")).select("_key", "_digest").distinct()
    if not by_row:
        return join_rows(docs, [key], gone.select("_key").distinct(), "left_anti")
    return join_rows(marked, [key, name], gone, "left_anti").drop(name)
