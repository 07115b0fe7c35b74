"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger keeps one row for each scanned pair of blob and rule version, so a run
reads only the pairs that are not in it yet, whatever number of paths and
versions share a blob.  Findings are then joined back to all paths.

All of it is DataFrame work.  Spark has no function for the places of all
matches, so they come from lengths: ``split`` gives the text between matches,
``regexp_extract_all`` the matches, and running sums of both give each start.

Defined results: a null content is an empty blob, and an empty one has no
findings; a very long one is scanned as a whole; spans of one start come in the
order of their kinds; a null path is a path like any other; repeated rows each
get their blob's findings; a ledger with repeated rows counts once; an empty
table gives no rows; columns of the input beside path and content are not read,
or go along in one struct, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.llm.common import SALTS, spread_join, table


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least so many characters are findings."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The base kinds and the further credential formats, in the order in which kinds are listed.
RULES = (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # a shorter run can't hold a longer one, so the bound may stand in the pattern
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
#: Names the rules above in a ledger; a change of RULES needs another name.
RULE_VERSION = "2026-1"

LEDGER_SCHEMA = "blob string, rule_version string, spans array<struct<start:long,kind_no:int,kind:string,end:long>>"


def blobs(versions: DataFrame, path: str, content: str) -> DataFrame:
    """(path, blob) of every version."""
    return versions.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("blob"))


def _hits(no: int, rule: Rule) -> tuple[Column, Column, Column]:
    """Matches, their checked groups and the text between matches, as arrays."""
    found = F.regexp_extract_all("content", F.lit(rule.pattern), F.lit(0))
    return found.alias(f"found{no}"), F.when(F.size(f"found{no}") > 0, F.regexp_extract_all("content", F.lit(rule.pattern), F.lit(rule.group))).alias(f"part{no}"), F.when(F.size(f"found{no}") > 0, F.split("content", rule.pattern, -1)).alias(f"gap{no}")


def scan(contents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of each blob with a finding, from rows (blob, content): blob, spans by start, then by kind as listed."""
    cols = [_hits(no, r) for no, r in enumerate(rules)]
    seen = contents.select("blob", "content", *(c[0] for c in cols))
    seen = seen.filter(F.greatest(*(F.size(f"found{no}") for no in range(len(rules)))) > 0)
    seen = seen.select("blob", *(f"found{no}" for no in range(len(rules))), *(x for c in cols for x in c[1:]))

    def rows(no: int, rule: Rule) -> Column:
        return F.transform(
            F.col(f"found{no}"),
            lambda x, i: F.struct(F.lit(no).alias("kind_no"), i.alias("i"), F.length(F.get(f"gap{no}", i)).alias("gap"), F.length(x).alias("len"), (F.length(F.get(f"part{no}", i)) >= rule.least).alias("ok")),
        )

    hits = seen.select("blob", F.concat(*(rows(no, r) for no, r in enumerate(rules))).alias("hits"))
    hits = hits.groupBy("blob").agg(F.first("hits").alias("hits"))  # a repeated row is one blob
    w = Window.partitionBy("blob", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.select("blob", F.inline("hits")).withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(w)).filter("ok")
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind_no") + 1)
    span = F.struct((F.col("end") - F.col("len")).alias("start"), F.col("kind_no"), kind.alias("kind"), F.col("end"))
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan_unseen(versions: DataFrame, path: str = "path", content: str = "content", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows: one for each blob of versions that the ledger lacks under this rule version, with its spans (none: an empty array)."""
    named = blobs(versions, path, content)
    new = named.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("no_path"), "path")).alias("at"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        new = new.join(known, "blob", "left_anti")
    # one version of each blob is read; rows are dealt by path, so the copies of one text don't meet in one task
    texts = versions.select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content")).withColumn("blob", F.sha2(F.col("content").cast("binary"), 256))
    same = [F.col("blob") == F.col("at_blob"), F.col("path").eqNullSafe(F.col("at_path"))]
    chosen = new.select(F.col("at.path").alias("at_path"), F.col("at.no_path").alias("chosen"), F.col("blob").alias("at_blob"))
    # content now depends on the other side, so no scan is moved in front of the join
    contents = texts.join(chosen, same).select("blob", F.when(F.col("chosen").isNotNull(), F.col("content")).alias("content"))
    found = scan(contents, rules)
    return new.select("blob").join(found, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", F.array().cast("array<struct<start:long,kind_no:int,kind:string,end:long>>")).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, path: str = "path", content: str = "content", rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, spans) of every version, from a ledger that covers all blobs."""
    # a run that was repeated may have appended its rows twice; rows of one pair are equal
    known = ledger.filter(F.col("rule_version") == rule_version).groupBy("blob").agg(F.first("spans").alias("spans"))
    return spread_join(blobs(versions, path, content), known, "blob", "path", "left").select("path", "blob", "spans")


def update_ledger(spark: SparkSession, versions: DataFrame, folder: str, path: str = "path", content: str = "content", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan what the Parquet ledger in folder lacks, append it, and return the findings of all versions."""
    try:
        ledger = spark.read.schema(LEDGER_SCHEMA).parquet(folder)
    except Exception as e:  # the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = spark.createDataFrame([], LEDGER_SCHEMA)
    scan_unseen(versions, path, content, ledger, rules, rule_version).write.mode("append").parquet(folder)
    return findings(versions, spark.read.schema(LEDGER_SCHEMA).parquet(folder), path, content, rule_version)


def redact(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by a mark; overlapping and touching spans get one mark.

    spans: rows (path, blob, spans) as findings() returns them.
    """
    known = spans.filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    # few texts have findings, so these go to all parts of the rows: the copies of one text don't meet in one task
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    t = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    built = F.aggregate(
        "spans",
        start,
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.when((s["start"] <= a["at"]) & (a["at"] > 0), a["out"]).otherwise(F.concat(a["out"], t.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).alias("out"))),
        lambda a: F.concat(a["out"], t.substr((a["at"] + 1).cast("int"), F.length(t))),
    )
    # other columns go along in one struct, so their names can't clash with ours
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row")
    rows = docs.select(F.col(text).alias("text"), others, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("blob"), salt).join(known, ["blob", "salt"], "left")
    rows = rows.withColumn("text", F.when(F.col("spans").isNotNull(), built).otherwise(t))
    return rows.select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = findings(docs, scan_unseen(docs, "doc_id", "text"), "doc_id", "text")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(F.col("path").alias("doc_id"), *(count(k) for k in BASE), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
