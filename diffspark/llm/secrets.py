"""Secret scans over an incremental ledger of content-addressed texts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.llm._common import LOWER, UPPER, checkpoint


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match of ``pattern`` counts if its ``group`` has ``least`` characters; ``hints``: one of them stands, lower-cased, in any text that matches. A changed rule takes a new ``version``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs are maximal, so those of 24 or more are all that count
)
# Public formats of keys that name themselves.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", hints=("aiza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----", hints=("-----begin",)),
    Rule("login", r"""://[^\x00-\x20/:@"'<>]+:[^\x00-\x20/:@"'<>]+@""", hints=("://",)),
    Rule("upper_hex", r"[0-9A-F]{24,}"),
)
RULES = BASE + ADDED

#: What a ledger folder holds: which rules have read which blob, and what they found.
LEDGER, FINDINGS = "blob binary, rule string", "blob binary, rule string, start long, end long"


def address(text: Column) -> Column:
    """The content address of a text: SHA-256 of its UTF-8 bytes; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _found(rule: Rule, lowered: Column, unread: Column | None) -> Column:
    """The matches of a rule: what lies before each since the last, its length, and the length of its value."""
    pattern, text = F.lit(rule.pattern), F.col("text")
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    hits = F.transform(parts, lambda x: F.struct(F.char_length(x["gap"]).cast("long").alias("gap"), F.char_length(x["whole"]).cast("long").alias("length"), F.char_length(x["value"]).alias("value")))
    when = F.rlike(text, pattern)
    if rule.hints:
        when = reduce(Column.__or__, (F.contains(lowered, F.lit(h)) for h in rule.hints)) & when
    if unread is not None:
        when = F.array_contains(unread, rule.key) & when
    return F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.least).alias("least"), F.when(when, hits).alias("hits"))


def scan(versions: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """What the rules find in the distinct texts of ``versions`` that the ledger (blob, rule) doesn't have yet: blob, rule, start, end, in code points with the end exclusive.

    Copies of a text are brought together by content address and read once, and a pair of blob and rule version that the ledger has is not read again; the ledger is joined by blob before any text is read. A rule's matches are leftmost and don't overlap. Positions are running sums over a text's own matches, within the partitioning by blob.
    """
    blobs = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["blob"])
    unread = None
    if ledger is not None:
        read = ledger.groupBy("blob").agg(F.collect_set("rule").alias("_read"))
        every = F.array(*(F.lit(r.key) for r in rules))
        blobs = blobs.join(read, "blob", "left").withColumn("_unread", F.array_except(every, F.coalesce("_read", F.array().cast("array<string>")))).where(F.size("_unread") > 0)
        unread = F.col("_unread")
    lowered = F.translate("text", UPPER, LOWER)
    by_rule = blobs.select("blob", F.explode(F.array(*(_found(r, lowered, unread) for r in rules))).alias("f")).where("f.hits is not null")
    hits = by_rule.select("blob", "f.rule", "f.least", F.posexplode("f.hits").alias("at", "hit"))
    end = F.sum(F.col("hit.gap") + F.coalesce("hit.length", F.lit(0))).over(W.partitionBy("blob", "rule").orderBy("at"))
    placed = hits.withColumn("end", end).where("hit.length is not null and hit.value >= least")
    return placed.select("blob", "rule", (F.col("end") - F.col("hit.length")).alias("start"), "end")


def trace(versions: DataFrame, findings: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of these rule versions joined back to every path: the columns of ``versions`` and ``spans``, an array of (kind, start, end) by start, then by the order of the rules; an input column of that name is replaced.

    A blob's findings are one row, so the join's sides are the paths and, at most, the distinct texts with a secret; Spark splits a blob that many paths hold.
    """
    order = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    own = findings.where(F.col("rule").isin([r.key for r in rules]))
    spans = F.transform(F.array_sort(F.collect_list(F.struct("start", order[F.col("rule")].alias("kind"), "end"))), lambda x: F.struct(F.get(kinds, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    by_blob = own.groupBy(F.col("blob").alias("_blob")).agg(spans.alias("_spans"))
    names = [c for c in versions.columns if c != "spans"]
    paths = versions.select(F.struct(*names).alias("_row"), address(F.col(text)).alias("_address"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    out = paths.join(by_blob, F.col("_address") == F.col("_blob"), "left")
    return out.select(*(F.col("_row")[c].alias(c) for c in names), F.coalesce("_spans", none).alias("spans"))


def secret_spans(versions: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of ``versions`` (any paths with their texts) and ``spans``: the secrets that the rules find, each text being read once however many paths hold it.

    Defined cases: a null text is an empty one and holds none; repeated rows and null ids give a row each; spans of different kinds may overlap; an empty table gives an empty table; other columns are passed on, but for one named spans.
    """
    return trace(versions, checkpoint(scan(versions, text=text, rules=rules)), text=text, rules=rules)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def update(versions: DataFrame, folder: str, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger in ``folder`` up to ``versions`` (any new or old versions of any paths), and return :func:`trace` of all its findings.

    Only blobs that no earlier call has read are read, or those that a new or changed rule has not read. Findings are written before the pairs that were read: a job lost between the two is repeated by the next call, and findings written twice count once.
    """
    spark = versions.sparkSession
    ledger = _table(spark, f"{folder}/ledger", LEDGER)
    checkpoint(scan(versions, text=text, rules=rules, ledger=ledger)).write.mode("append").parquet(f"{folder}/findings")
    pairs = versions.select(address(F.col(text)).alias("blob")).distinct().select("blob", F.explode(F.array(*(F.lit(r.key) for r in rules))).alias("rule"))
    checkpoint(pairs.join(ledger, ["blob", "rule"], "left_anti")).write.mode("append").parquet(f"{folder}/ledger")
    return trace(versions, _table(spark, f"{folder}/findings", FINDINGS).distinct(), text=text, rules=rules)
