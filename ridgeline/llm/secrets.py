"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for the base kinds and for a few tokens of fixed shape. Each found value is hashed, and the corpus
is counted by value: in how many repositories and by how many owners it stands. A value that many owners share, or that
stands in many repositories, is a widely copied example; one that stays with one owner and in few repositories, looks
random and names no placeholder is taken for live. A value that very many rows have is judged where they are read.

Nulls: a null text is empty and has no spans; a null owner or repository counts as one of its own. Repeated rows each
give a row, and count once as a repository (a repository is a distinct text). Very long texts are scanned whole; where two
kinds begin at one place both are told, in the kinds' order. An empty table gives an empty table. Other columns are ignored. Spans are code points of the whole text, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import join_skewed, settle, text_or_empty

#: The base kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds that the method adds, each of a fixed public shape.
ADDED = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
    ("vcs", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
]
KINDS = ["assign", "access", "hex", *(kind for kind, _ in ADDED)]
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|0000|1234", re.I)


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of its kind in KINDS, end, secret value) of every span, sorted."""
    spans = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    for k, (_, pattern) in enumerate(ADDED, 3):
        spans += [(m.start(), k, m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(spans)


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_random(value: str) -> bool:
    return len(value) >= 12 and entropy(value) >= 2.5 and not PLACEHOLDER.search(value)


SPAN = "struct<kind:string,start:bigint,end:bigint,value_hash:bigint,random:boolean>"


def spans(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Per row of docs: doc_id, repository, owner (both hashed), spans array<SPAN>."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["spans"] = [
                [{"kind": KINDS[k], "start": a, "end": b, "value_hash": xxhash.xxh3_64_intdigest(v) - 2**63, "random": looks_random(v)} for a, k, b, v in find(t)]
                for t in pdf.text
            ]
            yield pdf[["doc_id", "repository", "owner", "spans"]].astype({"doc_id": "Int64"})

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(repository).alias("repository"), F.xxhash64(owner).alias("owner"))
    return slim.mapInPandas(scan, f"doc_id bigint, repository bigint, owner bigint, spans array<{SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repositories, n_owners, n (spans) over the whole corpus. Pairs of repository and owner are counted
    first, so a value that stands in very many rows is reduced where it is read and again on each side of the exchange."""
    pairs = found.select("repository", "owner", F.explode("spans.value_hash").alias("value_hash")).groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = pairs.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.sum("n_repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n"))


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, example_owners: int = 3, example_repositories: int = 10) -> DataFrame:
    """One row for each row of docs: doc_id, spans (array of SPAN, in order), n_live, n_example, n_unclear.

    A span's value is an example if at least example_owners owners or example_repositories repositories have it, live if
    one owner has it in fewer and it looks random, else unclear. By default an owner is a source and a repository is a
    distinct text of it."""
    repository = F.concat_ws("\x01", F.col("source").cast("string"), F.col("text").cast("string")) if repository is None else repository
    owner = F.coalesce(F.col("source").cast("string"), F.lit("\x00")) if owner is None else owner
    found = settle(spans(docs, repository, owner).withColumn("row", F.monotonically_increasing_id()), "spans")
    spread = found.select("row", F.explode("spans").alias("s")).select("row", "s.value_hash", "s.random")
    judged = join_skewed(spread, settle(ownership(found), "owners"), "value_hash")
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories)
    live = (F.col("n_owners") == 1) & F.col("random")
    totals = judged.groupBy("row").agg(F.sum(example.cast("bigint")).alias("n_example"), F.sum((~example & live).cast("bigint")).alias("n_live"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    # rows without a span need no join
    without = found.where(F.size("spans") == 0).select("doc_id", "spans", zero.alias("n_live"), zero.alias("n_example"), zero.alias("n_unclear"))
    with_spans = found.where(F.size("spans") > 0).join(totals, "row").select("doc_id", "spans", "n_live", "n_example", (F.col("n") - F.col("n_live") - F.col("n_example")).alias("n_unclear"))
    return without.unionByName(with_spans)


def joined(spans_column: str, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    s = F.col(spans_column)
    if kinds:
        s = F.filter(s, lambda x: x.kind.isin(kinds))
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
