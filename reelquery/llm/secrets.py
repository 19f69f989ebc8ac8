"""Secret scans by an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import shared_dir, spool, table


class Rule(NamedTuple):
    """The first group of pattern is the secret. A text without any of the guards (literal), or without shape (a short pattern), can't match; it has neither where it must be searched."""

    rule: str
    version: int
    pattern: str
    guards: tuple[str, ...] = ()
    shape: str = ""

    @property
    def key(self) -> str:
        """How the ledger names a rule's version."""
        return f"{self.rule}@{self.version}"


RULES = (
    Rule("aws_access_key", 1, r"(?:^|[^0-9A-Za-z])(AKIA[0-9A-Z]{16})", ("AKIA",)),
    Rule("github_token", 1, r"(?:^|[^0-9A-Za-z])(gh[pousr]_[0-9A-Za-z]{36,})", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 1, r"(?:^|[^0-9A-Za-z])(xox[abprs]-[0-9A-Za-z-]{10,})", ("xox",)),
    Rule("google_api_key", 1, r"(?:^|[^0-9A-Za-z])(AIza[0-9A-Za-z_-]{35})", ("AIza",)),
    Rule("jwt", 1, r"(?:^|[^0-9A-Za-z])(eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})", ("eyJ",)),
    # With the body, where the text has its end, so that keys of a kind differ.
    Rule("private_key", 2, r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?)", ("PRIVATE KEY-----",)),
    Rule("assigned_secret", 1, r"(?i)(?:token|secret|passwd|password|api_?key)[\"']?[ \t]*[:=][ \t]*[\"']([0-9A-Za-z+/=_.-]{16,})[\"']", shape=r"[:=][ \t]*[\"']"),
)
#: The rules as they were before: a private key by its first line only.
EARLIER_RULES = tuple(r._replace(version=1, pattern="(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)") if r.rule == "private_key" else r for r in RULES)
FINDING = "struct<rule:string,version:int,nth:int,secret_sha256:string>"


def _possible(text: Column, rule: Rule) -> Column:
    """Whether a text gets past the rule's guards."""
    guard = F.lit(not rule.guards)
    for g in rule.guards:
        guard = guard | F.contains(text, F.lit(g))
    return guard & F.rlike(text, F.lit(rule.shape)) if rule.shape else guard


def _findings(wanted: Column, text: Column, r: Rule) -> Column:
    name = [F.lit(r.rule).alias("rule"), F.lit(r.version).alias("version")]
    secrets = F.when(F.array_contains(wanted, r.key), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(1)))
    return F.transform(secrets, lambda s, i: F.struct(*name, (i + 1).alias("nth"), F.sha2(s, 256).alias("secret_sha256")))


def _address(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def versions(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, path, blob, possible: every version's content address, the SHA-256 of its text, and the rules whose guards it gets past. Null texts have none."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"))
    possible = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(_possible(F.col("text"), r), F.lit(r.key)) for r in rules]))
    return docs.filter(F.col("text").isNotNull()).select("doc_id", path.alias("path"), _address(F.col("text")).alias("blob"), possible.alias("possible"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, found, hits): what this scan adds to ledger and findings, and the hits of docs (doc_id, source, text).

    ledger (blob, rules) has the rule versions ("name@version") that each blob was ever scanned
    for, in any number of rows; findings (blob, rule, version, nth, secret_sha256) what they
    gave. A pair that is in ledger isn't scanned again, and copies of a text are scanned once.
    A text that a rule's guards rule out is scanned for it by that. hits joins the findings of
    the current rule versions, old and new, back to all paths of docs: doc_id, path, blob and those of
    findings. A secret itself is never stored.

    Only texts with an unseen pair that gets past its guards are moved; of the others the
    address is.

    Null texts have no blob and no hits; an empty text is a blob without findings; very long
    texts are scanned whole. Repeated rows give repeated hits; documents with one doc_id and
    different texts are different versions. A null doc_id is an id like any other, and null in hits;
    a null source is ''. An empty table gives empty results. Other columns of docs aren't
    looked at, whatever they are called.
    """
    docs = docs.select("doc_id", "source", "text")
    known = spool(versions(docs, rules), "versions")
    keys = F.array(*[F.lit(r.key) for r in rules]).cast("array<string>")
    # One document stands for each blob.
    blobs = known.groupBy("blob").agg(F.min("doc_id").alias("rep"), F.first("possible").alias("possible"))
    if ledger is None:
        todo = blobs.withColumn("unseen", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("unseen", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("unseen") > 0)
    todo = spool(todo.select("blob", "rep", "unseen", F.array_intersect("unseen", "possible").alias("wanted")), "todo")
    wanted = spool(todo.filter(F.size("wanted") > 0).select("blob", "rep", "wanted"), "wanted")
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | _possible(F.col("text"), r)
    texts = docs.filter(F.col("text").isNotNull() & any_rule).select("doc_id", "text", _address(F.col("text")).alias("address"))
    rows = texts.join(wanted, (F.col("address") == F.col("blob")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "blob", "wanted")
    none = F.array().cast(f"array<{FINDING}>")
    found = F.flatten(F.array(none, *[F.coalesce(_findings(F.col("wanted"), F.col("text"), r), none) for r in rules]))
    new = rows.select("blob", F.explode(found).alias("f")).select("blob", "f.rule", "f.version", "f.nth", "f.secret_sha256").distinct()
    new = spool(new, "findings")
    scanned = todo.select("blob", F.col("unseen").alias("rules"))
    findings = new if findings is None else findings.unionByName(new)
    current = F.array_contains(keys, F.concat_ws("@", "rule", "version"))
    hits = known.join(findings.filter(current).distinct(), "blob").select("doc_id", "path", "blob", "rule", "version", "nth", "secret_sha256")
    return scanned, new, hits


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def scan_into(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The hits of scan, with the ledger and findings of earlier scans in folder, which this one adds to.

    Findings are written before the ledger: where a scan dies between, its pairs are scanned
    again, and findings that are there twice count once.
    """
    spark = docs.sparkSession
    scanned, found, hits = scan(docs, _read(spark, f"{folder}/ledger"), _read(spark, f"{folder}/findings"), rules)
    found.write.mode("append").parquet(f"{folder}/findings")
    scanned.write.mode("append").parquet(f"{folder}/ledger")
    return hits


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of the whole table after two scans with one ledger.

    The first scan sees half of the sources, and rules of which one has been changed since. The second
    sees all documents and the current rules, and scans what is new: all rules for the blobs
    that the first hasn't seen, and the changed rule for those that it has.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    scan_into(docs.filter(F.xxhash64("source") % 2 == 0), folder, EARLIER_RULES)
    return scan_into(docs, folder).withColumn("blob", F.lower(F.hex("blob")))


def _sql() -> str:
    one = "SELECT doc_id, source || '/' || doc_id AS path, sha256(text) AS blob, '{r.rule}' AS rule, {r.version}::INT AS version, regexp_extract_all(text, '{p}', 1) AS s FROM documents"
    parts = " UNION ALL ".join(one.format(r=r, p=r.pattern.replace("'", "''")) for r in RULES)
    return f"""
WITH found AS ({parts}), numbered AS (SELECT doc_id, path, blob, rule, version, unnest(s) AS secret, unnest(range(1, len(s) + 1))::INT AS nth FROM found)
SELECT doc_id, path, blob, rule, version, nth, sha256(secret) AS secret_sha256 FROM numbered
"""


OP1_SQL = _sql()
