"""Operator 5: secret scans with an incremental blob ledger (DataFrame functions only).

Every version of a document is addressed by the SHA-256 of its text. The
ledger has one row per (blob, rule, rule version) scanned so far, the findings
one row per span; the caller stores both and hands both to the next run
(``Store``). A scan takes the distinct blobs of the given versions, drops
the pairs that the ledger already has, scans only the rest, and joins the
stored findings of the current rule versions and the new ones back to every
path that holds the blob. Equal texts are scanned once:
the text shuffle is pre-aggregated per task, so a text that a third of all
paths share costs one row per task.

Rules are Java patterns; a match is kept if its measured part is long enough,
and dropped matches still use up their characters (leftmost, non-overlapping
per rule). Places are code points, end exclusive: the pieces between matches
and the matches are measured, and running sums give the places.

Null text counts as empty: no spans. Repeated rows and equal texts each keep
their row. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # whose length is measured
    least: int  # characters
    hint: str  # a cheap pattern without which the rule cannot match
    base: bool = True
    version: int = 1


# The patterns of the base kinds.
RULES = (
    Rule(
        "assign",
        r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1, 8, r"(?i)pass|secret|token|api",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, "PRIVATE KEY", False),
    Rule("hosted", r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})", 0, 1, "gh[pousr]_|xox|AIza", False),
)
LEDGER_SCHEMA = "blob string, kind string, version int"
FINDING_SCHEMA = "blob string, kind string, version int, start int, end int"


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob): the content address of every version."""
    return docs.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def blobs(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """(blob, body): one row per distinct text that a rule's hint occurs in."""
    body = F.col(text)
    hinted = F.lit(False)
    for r in rules:
        hinted = hinted | body.rlike(r.hint)
    return docs.where(body.isNotNull() & hinted).select(F.sha2(body, 256).alias("blob"), body.alias("body")).groupBy("blob").agg(
        F.first("body").alias("body")
    )


def matches(rule: Rule) -> Column:
    """array<struct<gap, size, part>>: length of the text before a match, of the match, and of its measured part."""
    body, pattern = F.col("body"), F.lit(rule.pattern)
    gaps = F.transform(F.split(body, rule.pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(body, pattern, F.lit(0)), lambda x: F.length(x))
    parts = sizes if rule.group == 0 else F.transform(F.regexp_extract_all(body, pattern, F.lit(rule.group)), lambda x: F.length(x))
    found = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), parts.alias("part"))
    return F.when(body.rlike(rule.hint), found)


def scan(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of (blob, body, kinds): the spans of every rule named in ``kinds``."""
    per_rule = F.array(*[
        F.struct(
            F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
            F.when(F.array_contains("kinds", r.kind), matches(r)).alias("found"),
        )
        for r in rules
    ])
    each = todo.select("blob", F.explode(per_rule).alias("r")).where("size(r.found) > 0").select("blob", "r.*")
    rows = each.select("blob", "kind", "version", "least", F.posexplode("found").alias("at", "m")).select(
        "blob", "kind", "version", "least", "at", F.col("m.gap").alias("gap"), F.col("m.size").alias("size"), F.col("m.part").alias("part")
    )
    # The matches of one rule in one text; the window ends with the text.
    upto = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")
    return rows.withColumn("end", end).where("part >= least").select(
        "blob", "kind", "version", (F.col("end") - F.col("size")).cast("int").alias("start"), "end"
    )


def scan_increment(
    docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(new findings, new ledger rows) for the blob and rule-version pairs that ``ledger`` does not have.

    The caller appends both to its tables; a later call with them scans only what is new.
    """
    spark = docs.sparkSession
    found = blobs(docs, rules, text)
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        todo = found.withColumn("kinds", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        done = ledger.select("blob", F.struct("kind", "version").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("done"))
        rest = F.filter(wanted, lambda w: F.col("done").isNull() | ~F.array_contains("done", w))
        todo = (
            found.join(done, "blob", "left").withColumn("kinds", F.transform(rest, lambda w: w["kind"]))
            .where("size(kinds) > 0").drop("done")
        )
    current = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    # One row per rule of the code: a fixed small side.
    pairs = versions(docs, text=text).select("blob").distinct().join(F.broadcast(current))
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    return scan(todo, rules), pairs.select("blob", "kind", "version")


class Store(NamedTuple):
    """What earlier runs scanned and found; repeated rows count once."""

    ledger: DataFrame
    findings: DataFrame


class Increment(NamedTuple):
    """What a run adds to a store, and all findings of its documents' texts by the current rules."""

    findings: DataFrame
    ledger: DataFrame
    current: DataFrame


def increment(docs: DataFrame, store: Store | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> Increment:
    """The rows to append to the stored tables, and the stored and new findings together."""
    new, pairs = scan_increment(docs, store.ledger if store else None, rules, text)
    if store is None:
        return Increment(new, pairs, new)
    columns = ["blob", "kind", "version", "start", "end"]
    # Findings without their ledger row, as a broken run leaves them, are scanned again and would count twice.
    versions_now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    old = store.findings.where(F.array_contains(versions_now, F.struct("kind", "version"))).select(*columns)
    return Increment(new, pairs, old.unionByName(new.select(*columns)).distinct())


def findings_by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): the spans of each blob by start, then rule order."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    return findings.groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("rule"), "end", "kind"))).alias("spans")
    )


def digests(docs: DataFrame, store: Store | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: counts of the base kinds, a digest of their spans, and all spans, of stored and new findings.

    What to append to the store is given by :func:`increment` of the same arguments.
    """
    rows = versions(docs).join(findings_by_blob(increment(docs, store, rules).current, rules), "blob", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,rule:int,end:int,kind:string>>"))
    base = [r.kind for r in rules if r.base]

    def shown(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.withColumn("spans", spans).select(
        F.col("path").alias("doc_id"), *[count(k) for k in base],
        F.sha2(shown(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]", store: Store | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one); n_chars follows; other columns stay."""
    by_blob = findings_by_blob(increment(docs, store, rules).current, rules).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    text = F.coalesce("text", F.lit(""))
    # Kept stretches: from the furthest end so far to the next start.
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        gap = x["start"] + 1 > s["at"]
        first = (s["at"] == 1) & (x["start"] == 0)
        piece = F.when(gap | first, F.concat(F.substring(F.col("text"), s["at"], x["start"] + 1 - s["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(s["at"], x["end"] + 1).alias("at"), F.concat(s["out"], piece).alias("out"))

    done = F.aggregate("__spans", state, step, lambda s: F.concat(s["out"], F.col("text").substr(s["at"], F.length("text"))))
    rows = docs.withColumn("__blob", F.sha2(text, 256)).join(by_blob, "__blob", "left")
    hit = F.size("__spans") > 0

    def column(c: str) -> Column:
        if c == "text":
            return F.col("__text").alias(c)
        if c == "n_chars":
            return F.when(hit, F.length("__text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
        return F.col(c)

    return rows.withColumn("__text", F.when(hit, done).otherwise(F.col("text"))).select(*map(column, docs.columns))
