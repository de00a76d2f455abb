"""Secret scan over a content-addressed ledger, with DataFrame functions only.

Every text version is addressed by its SHA-256.  The ledger is a written table with
one row for each (blob, rule, version) that was scanned, with the spans found, clean
ones included.  ``extend`` reads it, scans only blobs with a rule version it lacks,
each blob once however many documents hold it, and appends them; findings of the
current rules are joined back to all documents by address.  An append that fails
leaves nothing behind, so running it again scans what is still missing.

Defined cases: null texts are empty; documents with the same text share one
blob; documents that repeat, or whose id is null, keep their rows; offsets count
code points, the end is exclusive; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.llm import common


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` of a match needs ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


# The base kinds and their order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                   r"([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
KNOWN = Rule("known", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36,}"
                      r"|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
                      r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")
RULES = (*BASE, KNOWN)
SPAN = "array<struct<start:int,rule:int,end:int,kind:string>>"
LEDGER = f"blob string, rule string, version int, spans {SPAN}"


def spans(rule: Rule, number: int) -> Column:
    """Leftmost non-overlapping matches of a rule in ``text`` that are long enough."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all("text", pattern, F.lit(0))
    before = F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(matches))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("rule"),
                                end.alias("end"), F.lit(rule.kind).alias("kind")))
        fits = F.length(F.regexp_extract(pair["m"], rule.pattern, rule.group)) >= rule.least
        return F.struct(end.alias("at"), F.when(fits, F.concat(state["out"], span))
                        .otherwise(state["out"]).alias("out"))
    found = F.aggregate(
        F.arrays_zip(before.alias("b"), matches.alias("m")),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out")),
        add, lambda state: state["out"])
    return F.when(F.col("text").rlike(rule.pattern), found)


def addressed(docs: DataFrame) -> DataFrame:
    return common.texts(docs).withColumn("blob", F.sha2("text", 256))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES,
         ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, rule, version, spans) of the pairs not yet scanned.

    ``ledger`` (blob, rule, version) lists the pairs that are done.
    """
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))
                       for r in rules])
    blobs = addressed(docs).select("blob", "text")
    if ledger is None:
        todo = blobs.dropDuplicates(["blob"]).withColumn("open", wanted)
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(
            F.struct(F.col("rule").alias("kind"), "version")).alias("done"))
        left = blobs.select("blob").distinct().join(done, "blob", "left").select("blob", F.array_except(
            wanted, F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>"))).alias("open")) \
            .filter(F.size("open") > 0)
        todo = blobs.join(left, "blob").dropDuplicates(["blob"])
    found = F.map_from_arrays(
        F.array(*[F.lit(r.kind) for r in rules]),
        F.array(*[F.when(F.array_contains(F.col("open.kind"), r.kind), spans(r, i))
                  for i, r in enumerate(rules)]))
    scanned = todo.select("blob", "open", found.alias("found"))
    return scanned.select("blob", F.explode("open").alias("o"), "found").select(
        "blob", F.col("o.kind").alias("rule"), "o.version",
        F.col("found")[F.col("o.kind")].alias("spans"))


def extend(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks of ``docs``, append it, return the ledger."""
    spark = docs.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    old = spark.read.schema(LEDGER).parquet(path) if known else None
    scan(docs, rules, old).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): the spans that ``rules`` in their versions found in each blob
    that has some, by start, then rule.  Rows of older versions take no part."""
    current = F.struct("rule", "version").isin(*[
        F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    return ledger.filter((F.size("spans") > 0) & current).groupBy("blob").agg(
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))


def by_document(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans): all spans of each document, by start, then rule."""
    found = by_blob(ledger, rules)
    return addressed(docs).select("doc_id", "blob").join(found, "blob", "left").withColumn(
        "spans", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")))


def joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests per document."""
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == number)).cast("long")
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Documents, given (blob, spans), with every span, overlapping ones joined, replaced by ``mark``."""
    blob, spans = common.free(docs, "_blob"), common.free(docs, "_spans")
    spans_of = found.select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    rows = docs.join(spans_of, F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col(blob), "left")

    def put(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], gap, F.lit(mark)))
                        .otherwise(state["out"]).alias("out"))
    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put,
                        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    out = rows.withColumn("text", F.when(F.col(spans).isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
