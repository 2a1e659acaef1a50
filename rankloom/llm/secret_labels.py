"""Labelled findings for the secret scan, where nobody has labelled any by hand.

Labels come from evidence the forest does not see: what was planted, and what
a value proves of itself.

* Findings of known kinds, secrets and things that only look like them, are
  generated and put between words of a bounded sample of the documents, so
  that the text around them is the corpus's own.
* Values found in the documents are labelled where their form proves what they
  are: issuers' prefixes, tokens whose head decodes to an object with an
  algorithm, numbers with a right check digit, identifiers with a version.
"""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import python_workers

#: documents that lend their words, and findings planted in each
HOSTS, EACH = 2_000, 8

# fixed values: alphabets, names, formats of issuers
HEX, DIGITS = "0123456789abcdef", "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAMES = "token api_key apikey secret password DB_PASSWORD access_key private_key auth_token client-secret SECRET_KEY pwd".split()
ORDINARY = "id name commit digest checksum etag version build order ref key_id session page release sku".split()
PREFIXES = {"AKIA": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_": (LETTERS + DIGITS, 36), "sk_live_": (LETTERS + DIGITS, 24), "xoxb-": (DIGITS + LETTERS, 40), "AIza": (LETTERS + DIGITS + "_-", 35)}
PLACEHOLDERS = "your_token_here_1 changeme12345678 xxxxxxxxxxxxxxxx1 example_password_01 insert-key-here-0000 REPLACE_ME_WITH_KEY1".split()
ISSUED = re.compile("|".join(f"{re.escape(p)}[{re.escape(a)}]{{{n}}}" for p, (a, n) in PREFIXES.items()))
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", re.I)


def check_digit(number: str) -> str:
    """The last digit that makes a card number right."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(number))))
    return str(-total % 10)


def proven(value: str | None) -> int | None:
    """1 or 0 where a value's form proves that it is a secret or none, else None."""
    if not value:
        return None
    if ISSUED.fullmatch(value):
        return 1
    head = value.split(".")[0]
    if value.count(".") == 2 and head.startswith("eyJ"):
        try:
            return 1 if "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))) else None
        except ValueError:
            return None
    if UUID.fullmatch(value):
        return 0
    if value.isascii() and value.isdigit() and 13 <= len(value) <= 19:
        return 0 if check_digit(value[:-1]) == value[-1] else None
    return None


def token(draw: random.Random, alphabet: str, n: int) -> str:
    return "".join(draw.choices(alphabet, k=n))


def joined(draw: random.Random, name: str, value: str) -> str:
    """An assignment in one of the usual ways."""
    quote = draw.choice(["", '"', "'"])
    return draw.choice([f"{name}={quote}{value}{quote}", f"{name} = {quote}{value}{quote}", f'"{name}": "{value}"', f"{name}: {value}", f"{name} := {quote}{value}{quote}"])


def secret_finding(draw: random.Random) -> tuple[str, str, str]:
    """(kind, text, value) of a generated secret."""
    kind = draw.choice(["assigned", "assigned", "bearer", "issued", "web token", "key body", "userinfo", "flag"])
    value = token(draw, draw.choice([HEX, LETTERS + DIGITS, LETTERS + DIGITS + "+/", LETTERS + DIGITS + "_-"]), draw.randint(18, 48)) + draw.choice(DIGITS)
    if kind == "assigned":
        return kind, joined(draw, draw.choice(NAMES), value), value
    if kind == "bearer":
        return kind, f"Authorization: Bearer {value}", value
    if kind == "issued":
        prefix = draw.choice(list(PREFIXES))
        value = prefix + token(draw, PREFIXES[prefix][0][:-1], PREFIXES[prefix][1] - 1) + "7"
        return kind, draw.choice([value, f"key {value}", joined(draw, draw.choice(ORDINARY), value)]), value
    if kind == "web token":
        part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
        value = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': str(draw.randrange(10**12)), 'iat': draw.randrange(10**9)})}.{token(draw, LETTERS + DIGITS + '_-', 42)}9"
        return kind, draw.choice([value, f"cookie {value}"]), value
    if kind == "key body":
        value = "MII" + token(draw, LETTERS + DIGITS + "+/", 60) + "4"
        return kind, f"-----BEGIN PRIVATE KEY-----\n{value}", value
    if kind == "userinfo":
        value = token(draw, LETTERS + DIGITS + "!$_", draw.randint(8, 20)) + "3"
        return kind, f"{draw.choice(['https', 'postgres', 'ftp'])}://{token(draw, LETTERS, 6)}:{value}@host{draw.randrange(99)}.example.net/db", value
    return kind, f"--{draw.choice(['token', 'password', 'secret'])} {value}", value


def plain_finding(draw: random.Random, words: list[str]) -> tuple[str, str, str]:
    """(kind, text, value) of a generated thing that only looks like a secret."""
    kind = draw.choice(["digest", "digest", "uuid", "number", "identifier", "slug", "placeholder", "build"])
    some = [w for w in (re.sub(r"[^A-Za-z]", "", draw.choice(words)) for _ in range(6)) if w] or ["some", "words"]
    if kind == "digest":
        value = token(draw, HEX, draw.choice([32, 40, 64]) - 1) + draw.choice(DIGITS)
        return kind, draw.choice([f"{draw.choice(['sha256', 'md5', 'commit', 'checksum', 'digest'])} {value}", joined(draw, draw.choice(["commit", "digest", "checksum", "etag"]), value), value]), value
    if kind == "uuid":
        h = token(draw, HEX, 32)
        value = f"{h[:8]}-{h[8:12]}-4{h[13:16]}-a{h[17:20]}-{h[20:]}"
        return kind, draw.choice([value, joined(draw, "id", value), f"request {value}"]), value
    if kind == "number":
        number = token(draw, DIGITS, draw.randint(15, 18))
        value = number + check_digit(number)
        return kind, draw.choice([value, f"card {value}", f"order {value}", joined(draw, "order", value)]), value
    if kind == "identifier":
        value = draw.choice(["_", "", "-"]).join(w.lower() if draw.random() < 0.5 else w.title() for w in some) + str(draw.randrange(99)) + "x" * max(0, 17 - sum(map(len, some)))
        return kind, draw.choice([value, joined(draw, draw.choice(ORDINARY), value)]), value
    if kind == "slug":
        value = "/".join(w.lower() for w in some) + f"/{draw.randrange(1000, 9999)}-" + "-".join(w.lower() for w in some[:3])
        return kind, f"see {value}", value
    if kind == "placeholder":
        value = draw.choice(PLACEHOLDERS)
        return kind, joined(draw, draw.choice(NAMES), value), value
    value = f"{draw.choice(some).lower()}-{draw.randrange(9)}_{draw.randrange(99)}_{draw.randrange(99)}-release-build-{draw.randrange(9999)}"
    return kind, joined(draw, draw.choice(["version", "build", "release"]), value), value


def planted_findings(docs: DataFrame, text: str, path: str | None, hosts: int = HOSTS, each: int = EACH, seed: int = 1) -> DataFrame:
    """(text, path, planted, label, kind): short texts of the corpus's own words with one finding each, half of them secrets.

    The words come from at most ``hosts`` documents, those with the least
    hashes.  Without any words the findings stand alone.  The same documents
    and seed give the same findings.
    """
    python_workers(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        (F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")).alias("path"),
    )
    rows = rows.withColumn("h", F.xxhash64("text", "path"))
    last = rows.select("h").distinct().orderBy("h").limit(hosts).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= F.lit(last).cast("bigint"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for whole, where, h in zip(*(c.to_pylist() for c in batch.columns)):
                draw = random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{h}".encode()).digest()[:8], "big"))
                words = whole.split() or ["text"]
                for i in range(each):
                    at = draw.randrange(len(words))
                    kind, shown, value = plain_finding(draw, words) if i % 2 else secret_finding(draw)
                    near = [*words[max(0, at - 12) : at], shown, *words[at : at + 12]]
                    out.append((h, i, " ".join(near), where, value, 1 - i % 2, kind))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema)

    texts = [(n, pa.string()) for n in ("text", "path", "planted")]
    schema = pa.schema([("h", pa.int64()), ("i", pa.int32()), *texts, ("label", pa.int32()), ("kind", pa.string())])
    found = rows.mapInArrow(work, "h bigint, i int, text string, path string, planted string, label int, kind string")
    return found.dropDuplicates(["h", "i"]).drop("h", "i")  # copies of a document lend their words once


def by_form(found: DataFrame) -> DataFrame:
    """Candidates whose value proves what it is, with their ``label``."""
    judged = F.udf(lambda value: proven(value), T.IntegerType())(F.col("value"))
    return found.withColumn("label", judged).where("label is not null")
