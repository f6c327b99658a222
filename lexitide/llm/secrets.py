"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content.  A
ledger remembers which (blob, rule, rule version) triples have been scanned and
what was found; a scan reads the text of one representative of each blob that
has an unseen rule, applies the unseen rules alone, appends to the ledger, and
joins the ledger's findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import fits, materialize, text_of

#: About 8 MB of keys: a small increment. Beyond it texts move to their keys.
BROADCAST_BLOBS = 20_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    Raise ``version`` with any change, so that seen blobs are scanned again.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # maximal runs: the same spans as runs of any length of which short ones are dropped
)
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + EXTRA
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(text: Column, rule: Rule) -> Column:
    """Spans of a rule's matches in code points: pieces between matches and the matches alternate."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    inner = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group) if rule.group else matches
    parts = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches)).alias("p"), matches.alias("m"), inner.alias("g"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(parts, zero, step, lambda a: a["out"])).otherwise(F.array().cast(_SPANS))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("doc_id",), broadcast_blobs: int = BROADCAST_BLOBS) -> DataFrame:
    """(keys, blob, spans) of every row, spans an array of (kind, start, end) in the order of the rules.

    ``ledger`` is a folder of the shared file system; an empty or missing one
    knows nothing.  ``keys`` name a version of a path.  Null text counts as
    empty; empty text, null keys and repeated rows are scanned and joined like
    others.  Other columns are ignored.  No rows give no rows.

    Findings are appended before the blobs are marked as seen; a scan that is
    cut off in between is repeated, and its repeated findings count once.
    """
    spark = docs.sparkSession
    scanned = _read(spark, f"{ledger}/scanned", "blob string, rules array<string>")
    rows = docs.select(*keys, text_of().alias("text")).withColumn("blob", F.sha2("text", 256))
    addressed = materialize(rows.drop("text"), "blobs")
    blobs = addressed.groupBy("blob").agg(F.min(F.struct(*keys)).alias("at"))
    seen = scanned.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    every = F.array(*[F.lit(r.name) for r in rules])
    pending = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    pending = materialize(pending.select(*[F.col(f"at.{k}").alias(f"_{k}") for k in keys], F.col("blob").alias("_blob"), "rules"), "pending")
    side = F.broadcast(pending) if fits(pending, broadcast_blobs) else pending.hint("shuffle_hash")  # texts are streamed past the keys, not sorted
    same = F.col("blob") == F.col("_blob")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    found = F.concat(*[F.when(F.array_contains("rules", r.name), find(F.col("text"), r)).otherwise(F.array().cast(_SPANS)) for r in rules])
    fresh = rows.join(side, same).select("blob", "rules", F.explode(found).alias("span")).select("blob", "span")
    versions = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    fresh.select("blob", "span.*").withColumn("version", versions[F.col("kind")]).write.mode("append").parquet(f"{ledger}/findings")
    pending.select(F.col("_blob").alias("blob"), "rules").write.mode("append").parquet(f"{ledger}/scanned")
    known = _read(spark, f"{ledger}/findings", "blob string, kind string, start int, end int, version int")
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    valid = known.where(versions[F.col("kind")] == F.col("version")).distinct().withColumn("k", order[F.col("kind")])
    spans = valid.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end", "kind"))).alias("spans"))
    out = addressed.join(spans, "blob", "left")
    return out.select(*keys, "blob", F.coalesce(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), F.array().cast(_SPANS)).alias("spans"))
