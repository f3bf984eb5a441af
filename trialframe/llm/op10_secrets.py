"""Secret scan with corpus-wide ownership frequency.

Three base patterns and a broader search for random-looking tokens give
candidate values.  Every value is hashed, and Spark counts over the whole
corpus in how many repositories and under how many owners each hash occurs.
A value with several owners, or of two owners and in many repositories, is a
widely copied example.  Any other value that looks random is a live-looking
credential and adds a ``live`` span, however often its one owner repeats it.
Base spans stay in any case.

Ownership: an owner is a value of ``owner_col`` (the query: ``source``; null
counts as the owner ""), a repository a value of ``repo_col`` within an owner
(the query: ``doc_id``).  Values are counted once per repository before the
shuffle by hash, so a value that a third of all rows share costs one row per
task and owner.

Defined cases: null or empty text has no spans; a repeated row gives a row
each; any length is scanned whole; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import CHUNK, give_back, map_rows, one_row_per, outside, sha_hex, shared_table, span_text, table

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "live")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Candidates beyond them: runs of token characters with a digit, of 20 or more.
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
EXAMPLE_OWNERS = 3        # as many owners make a value a widely copied example
EXAMPLE_REPOS = 10        # or as many repositories of at least two owners; one owner's copies are its own
MIN_ENTROPY = 3.0         # bits a character of a random-looking value
MIN_LIVE = 16             # characters of a live-looking value


def find_base(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end), leftmost and non-overlapping per kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            out.append(("assign", m.start(), m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        out += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return out


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def random_looking(value: str) -> bool:
    """Long, with digits, of many different characters (no words, counters or placeholders)."""
    return (len(value) >= MIN_LIVE and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
            and entropy(value) >= MIN_ENTROPY)


def candidates(text: str, base: list) -> list[tuple[int, int, int]]:
    """(hash, start, end) of the random-looking values in base and loose spans, each place once."""
    own = {(s, e) for *_, s, e in base}
    places = own | set(outside((m.span() for m in LOOSE.finditer(text)), own))
    out = []
    for s, e in sorted(places):
        value = text[s:e]
        if random_looking(value):
            h = int.from_bytes(hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)
            out.append((h, s, e))
    return out


def scan(df: DataFrame, row_cols: list[str], text_col: str, owner_col: str, repo_col: str,
         hits_only: bool = False) -> DataFrame:
    """Per input row its ``row_cols`` as ``row``, owner, repository, base spans and candidates; with ``hits_only``
    the rows that have one of either."""

    def make():
        def run(rows):
            for row_id, row, text, owner, repo in rows:
                text = text or ""
                base = find_base(text)
                cands = candidates(text, base)
                if base or cands or not hits_only:
                    yield (row_id, row, owner, repo, [{"kind": k, "start": s, "end": e} for k, s, e, *_ in base],
                           [{"hash": h, "start": s, "end": e} for h, s, e in cands])
        return run

    src = df.select(F.struct(*row_cols).alias("row"), F.col(text_col).alias("text"),
                    F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
                    F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"))
    row = src.schema["row"].dataType.simpleString()
    src = one_row_per(src).select("row_id", "row", "text", "owner", "repo")
    return map_rows(src, make, f"row_id bigint, row {row}, owner string, repo string, "
                    "base array<struct<kind:string,start:int,end:int>>, "
                    "cands array<struct<hash:bigint,start:int,end:int>>")


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos over the whole corpus."""
    seen = (scanned.select("owner", "repo", F.explode(F.array_distinct("cands.hash")).alias("hash"))
            .groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")))
    per_owner = seen.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def judge(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """``row, base, live, example`` of scanned rows (a written table): base spans, live-looking spans and the spans
    of widely copied examples, as arrays of (kind, start, end)."""
    cand = scanned.select("row_id", F.explode("cands").alias("c")).select("row_id", "c.hash", "c.start", "c.end")
    span = lambda kind: F.struct(F.lit(kind).alias("kind"), "start", "end")
    shared = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos))
    judged = (cand.join(ownership(scanned), "hash").groupBy("row_id")
              .agg(F.collect_list(F.when(~shared, span("live"))).alias("live"),
                   F.collect_list(F.when(shared, span("example"))).alias("example")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return (scanned.filter(F.size("cands") > 0).join(judged, "row_id", "left")
            .unionByName(scanned.filter(F.size("cands") == 0).withColumns({"live": none, "example": none}))
            .select("row", "base", F.coalesce("live", none).alias("live"), F.coalesce("example", none).alias("example")))


def find_secrets(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str,
                 example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """``id_col, base, live, example`` for every row (see ``judge``)."""
    scanned = shared_table(scan(df, [id_col], text_col, owner_col, repo_col), "secrets")
    return judge(scanned, example_owners, example_repos).select("row.*", "base", "live", "example")


def masked(df: DataFrame, text_col: str, owner_col: str, repo_col: str, length_col: str | None = None,
           example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """All rows; in the texts every secret, but for widely copied examples, is replaced by a mark, and
    ``length_col`` follows the new length."""
    hits = shared_table(scan(df, df.columns, text_col, owner_col, repo_col, hits_only=True), "secret-rows")
    names, place = df.columns, df.columns.index(text_col)

    def make():
        def run(rows):
            for row, base, live, example in rows:
                row = dict(zip(names, row.values(), strict=True))
                shared = {(x["start"], x["end"]) for x in example}
                spans = [(x["start"], x["end"]) for x in base + live]
                free = [(s, e) for s, e in spans if not any(s < b and a < e for a, b in shared)]
                row[text_col] = redact(row[text_col], free)
                if length_col:
                    row[length_col] = len(row[text_col])
                yield tuple(row.values())
        return run

    def clean(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                yield part.filter(pa.array([not has_secret(t or "") for t in part.column(place).to_pylist()], pa.bool_()))
        give_back()

    return df.mapInArrow(clean, df.schema).unionByName(map_rows(judge(hits, example_owners, example_repos), make, df.schema))


def has_secret(text: str) -> bool:
    base = find_base(text)
    return bool(base or candidates(text, base))


def digest(found: DataFrame, id_col: str) -> DataFrame:
    """The contract's columns from the spans of ``find_secrets``."""

    def make():
        def run(rows):
            for key, base, live, example in rows:
                b = [(x["kind"], x["start"], x["end"]) for x in base]
                n = Counter(k for k, *_ in b)
                added = [(x["kind"], x["start"], x["end"]) for x in live]
                yield (key, *(n[k] for k in BASE_KINDS), sha_hex(span_text(b, BASE_KINDS)),
                       span_text(b + added, KINDS), len(live), len(example))
        return run

    key = found.schema[id_col].dataType.simpleString()
    return map_rows(found.select(id_col, "base", "live", "example"), make,
                    f"`{id_col}` {key}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
                    "spans string, n_live bigint, n_example bigint", chunk=2048)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each maximal union of ``spans`` replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(find_secrets(docs, "doc_id", "text", "source", "doc_id"), "doc_id")
