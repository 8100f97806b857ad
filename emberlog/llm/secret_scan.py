"""Secret scan with corpus-wide ownership frequency.

Each text is scanned once for the three base kinds and for *candidates*: long tokens that
mix letters and digits with high entropy, wherever they stand. Hashes of the values of
both (never the values) are then aggregated over the whole corpus by distinct repositories
and by distinct owners, each first made distinct before it is counted. A value that many
owners or repositories hold is a widely copied example; a value of few looks live. Spans of
live candidates are added as kind ``owned``. Base spans always stay, of whatever length
their values are, and are told apart as live or copied examples.

Defined results of edge cases: a null text is empty and has no spans; a null owner is one
owner, a null repository is one repository; repeated rows are rows of their own and add
no owner; a value that is repeated in one text is counted once there; an empty table gives
an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed by the contract: letters of assign in either case, a value of 8 or more; 16 or more; 32 or more.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A run of credential characters that no such character touches.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}")
KINDS = ("assign", "access", "hex", "owned")
MIN_ENTROPY = 3.0


def base_values(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value); a shorter AKIA run or hex run has no long enough part, so the length stands in the pattern."""
    found = [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    return found + [(kind, *m.span(), m[0]) for kind, pattern in (("access", ACCESS), ("hex", HEX)) for m in pattern.finditer(text)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [v[:3] for v in base_values(text)]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(owned, start, end, value) of the tokens that are owned if few hold them."""
    return [("owned", *m.span(), m[0]) for m in CANDIDATE.finditer(text) if any(c.isalpha() for c in m[0]) and entropy(m[0]) >= MIN_ENTROPY]


def value_hash(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("uid", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()),
    ("repository", pa.string()), ("owner", pa.string()), ("found", pa.list_(pa.struct([("h", pa.string()), ("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))),
])
SCHEMA_SQL = "doc_id long, uid string, n_assign long, n_access long, n_hex long, base string, repository string, owner string, found array<struct<h string, kind string, a int, b int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import uuid

    task = uuid.uuid4().hex  # rows have names of their own, which hold once they are written
    n = 0
    for batch in batches:
        rows = []
        for doc_id, text, repository, owner in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "repository", "owner")), strict=True):
            text = text or ""
            base = base_values(text)
            spans = [v[:3] for v in base]
            kinds = Counter(k for k, _, _ in spans)
            found = [{"h": value_hash(v), "kind": k, "a": a, "b": b} for k, a, b, v in base + candidates(text)]
            rows.append({"doc_id": doc_id, "uid": f"{task}{n}", "n_assign": kinds["assign"], "n_access": kinds["access"], "n_hex": kinds["hex"], "base": joined(spans), "repository": repository, "owner": owner, "found": found})
            n += 1
        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def scan(spark: SparkSession, docs: DataFrame, repository: str, owner: str, max_owners: int = 2, max_repositories: int = 8) -> DataFrame:
    """doc_id, counts and joined spans by base kind, and ``live``: (kind, a, b) of the owner-specific values' spans.

    A value is owner-specific if at most max_owners owners and max_repositories
    repositories hold it. Null owners and repositories count as one each.
    """
    scratch = Scratch(spark, "secrets")
    text = F.col("text")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"))
    rows = scratch.save(source.mapInArrow(_scan, SCHEMA_SQL), "rows")
    spans = rows.where(F.size("found") > 0).select("uid", "repository", "owner", F.explode("found").alias("f")).select("uid", "repository", "owner", "f.*")

    def holders(column: str) -> DataFrame:
        return spans.select("h", column).distinct().groupBy("h").agg(F.count("*").alias(f"n_{column}"))

    few = holders("owner").where(F.col("n_owner") <= max_owners).join(holders("repository").where(F.col("n_repository") <= max_repositories), "h").select("h")
    live = spans.join(few, "h", "left_semi").groupBy("uid").agg(F.collect_list(F.struct("kind", "a", "b")).alias("live"))
    none = F.array().cast("array<struct<kind:string,a:int,b:int>>")
    return rows.drop("found", "repository", "owner").join(live, "uid", "left").drop("uid").withColumn("live", F.coalesce("live", none))


def digests(found: DataFrame) -> DataFrame:
    """The contract's digest columns of what scan() returns; base spans are told apart in live_spans and example_spans."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def keyed(a: Column, kind: Column, b: Column) -> Column:
        return F.struct(a.cast("int").alias("a"), F.array_position(kinds, kind).alias("k"), b.cast("int").alias("b"))

    def of_text(s: Column) -> Column:
        parts = F.split(s, ":")
        return keyed(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)), F.get(parts, F.lit(2)))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, (s["k"] - 1).cast("int")), s["a"], s["b"])), ",")

    base = F.transform(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ",")), of_text)
    live = F.transform("live", lambda s: keyed(s["a"], s["kind"], s["b"]))
    owned = F.filter(live, lambda s: s["k"] == len(KINDS))
    texts = {"spans": F.concat(base, owned), "live_spans": F.filter(live, lambda s: s["k"] < len(KINDS)), "example_spans": F.filter(base, lambda s: ~F.array_contains(live, s))}
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), *(text(spans).alias(name) for name, spans in texts.items()))
