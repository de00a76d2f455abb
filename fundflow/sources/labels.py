"""Attribution files to label rows (address, chain, entity_name, category,
confidence, source).  Each loader reads a folder or file with Spark and keeps
the provenance of its source; nothing here decides what a label means."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions import text as X
from fundflow.session import materialise

# Executors get these functions by value, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


EXPLORER_CHAIN_ID = "1"
DIRECTORY_LIMIT = 10_000


def _rows(df: DataFrame, source: str) -> DataFrame:
    return df.select("address", "chain", "entity_name", "category",
                     F.lit(source).alias("source"), "confidence")


def _whole_files(spark: SparkSession, path: str, end: str, what: str) -> None:
    """Raise unless there is a file and every file ends with ``end``: a page of
    an error or half a download must never pass for a list without entries."""
    # lines, since a file as one row must fit a task; its last line with text decides
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), X.strip(F.col("value")).alias("line"),
        F.struct(F.col("_metadata.file_block_start").alias("b"),
                 F.monotonically_increasing_id().alias("i")).alias("at"))
    ends = lines.groupBy("path").agg(F.max(F.when(
        F.col("line") != "", F.struct("at", F.substring("line", -200, 200).alias("tail")))).alias("last")) \
        .select("path", F.coalesce(F.col("last.tail").endswith(end), F.lit(False)).alias("whole"))
    seen = ends.agg(F.count(F.lit(1)).alias("n"), F.min_by("path", "whole").alias("path"),
                    F.bool_and("whole").alias("whole")).first()
    if not seen["n"]:
        raise ValueError(f"{what} is empty: {path}")
    if not seen["whole"]:
        raise ValueError(f"{what} is broken or cut off: {seen['path']}")


def _items(spark: SparkSession, path: str, schema: str, column: str, what: str) -> DataFrame:
    """Rows (source_note, ord, item) of the list ``column`` of JSON files.  A
    file that is no JSON, or has no such list, raises when it is read."""
    _whole_files(spark, path, "}", what)
    raw = spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(schema).json(path)
    found = F.coalesce(F.col(column), F.raise_error(F.lit(f"{what} has no list '{column}'"))
                       .cast(raw.schema[column].dataType))
    note = F.col("source_note") if "source_note" in raw.columns else F.lit(None).cast("string")
    return raw.select(note.alias("source_note"), F.posexplode(found).alias("ord", "item"))


def load_sdn(spark: SparkSession, path: str, source: str = "ofac_sdn") -> DataFrame:
    """Sanctions list XML: digital-currency identifiers of every entry.  A file
    that does not end as the list does raises, so the old snapshot stays."""
    _whole_files(spark, path, "</sdnList>", "sanctions list")
    schema = ("firstName string, lastName string, "
              "idList struct<id: array<struct<idType: string, idNumber: string>>>")
    entries = spark.read.format("xml").option("rowTag", "sdnEntry").schema(schema).load(path)
    name = F.concat_ws(" ", "firstName", "lastName")
    ids = entries.select(
        F.when(name == "", "OFAC SDN entity").otherwise(name).alias("entity"),
        F.explode("idList.id").alias("id")).select(
        "entity", X.strip(F.col("id.idType")).alias("kind"), X.strip(F.col("id.idNumber")).alias("raw")) \
        .filter(F.col("kind").startswith("Digital Currency Address") & (F.col("raw") != ""))
    suffix = X.strip(F.element_at(F.split("kind", "-"), -1))
    chain = X.asset_chain(suffix, F.col("raw"))
    return _rows(ids.select(
        X.norm_addr(F.col("raw"), chain).alias("address"), chain.alias("chain"),
        F.concat(F.lit("OFAC SDN: "), "entity").alias("entity_name"),
        F.lit(S.SANCTIONED).alias("category"), F.lit("high").alias("confidence")), source)


_TAG_SCHEMA = ("path string, error string, pack_label string, pack_currency string, "
               "pack_category string, pack_lastmod string, address string, label string, "
               "currency string, category string")


def _parse_packs(batches):
    import yaml
    columns = [c.split()[0] for c in _TAG_SCHEMA.split(", ")]

    def text(value):
        return None if value is None else str(value)
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                pack = yaml.safe_load(content)
                if not isinstance(pack, dict):
                    raise ValueError("unexpected format")
            except Exception as exc:  # one bad file must not stop the import
                rows.append([path, str(exc)[:300]] + [None] * 8)
                continue
            head = [path, None, *(text(pack.get(k)) for k in
                                  ("label", "currency", "category", "lastmod"))]
            tags = [t for t in pack.get("tags") or [] if isinstance(t, dict)]
            rows += [head + [text(t.get(k)) for k in
                             ("address", "label", "currency", "category")] for t in tags]
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def read_tagpacks(spark: SparkSession, path: str, glob: str = "*.yaml",
                  names: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Parsed tags of every pack, and the files left out with the reason: those
    that cannot be parsed and, where ``names`` is given, those whose name does
    not fit it.  Files are parsed once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(path)
    fits = F.element_at(F.split("path", "/"), -1).rlike(names) if names else F.lit(True)
    parsed = materialise(files.filter(fits).select("path", "content").mapInPandas(
        _parse_packs, _TAG_SCHEMA), "packs", rebalance=False)
    skipped = files.filter(~fits).select("path", F.lit("name").alias("reason")).unionByName(
        parsed.filter("error is not null").select("path", F.col("error").alias("reason")))
    return parsed.filter("error is null"), skipped


def load_tagpacks(tags: DataFrame, source: str = "graphsense_tagpack",
                  name: str = "TagPack") -> DataFrame:
    """Exchange and mixer tags; header fields are inherited by tags that do not
    set them, and the pack date goes into the entity text."""
    label = X.strip(F.coalesce(F.when(X.strip(F.col("label")) != "", F.col("label")),
                              F.col("pack_label")))
    currency = F.upper(F.coalesce("currency", "pack_currency", F.lit("")))
    chain = F.coalesce(X.lookup_literal(currency, X.TAGPACK_CURRENCY_CHAIN),
                       F.lower(currency))
    category = F.lower(F.coalesce("category", "pack_category", F.lit("")))
    stamp = F.when(F.coalesce("pack_lastmod", F.lit("")) != "", F.concat(
        F.lit(", as of "), F.substring("pack_lastmod", 1, 10))).otherwise(F.lit(""))
    address = X.strip(F.col("address"))
    rows = tags.select(
        X.norm_addr(address, chain).alias("address"), chain.alias("chain"),
        F.concat(label, F.lit(f" [{name}"), stamp, F.lit("]")).alias("entity_name"),
        category.alias("category"), F.lit("medium").alias("confidence"))
    return _rows(rows.filter(
        (F.coalesce("address", F.lit("")) != "") & (F.col("chain") != "")
        & F.col("entity_name").isNotNull() & ~F.col("entity_name").startswith(" [")
        & F.col("category").isin(S.EXCHANGE, S.MIXER)), source)


def load_blacklist(spark: SparkSession, path: str, source: str = "scamsniffer") -> DataFrame:
    """JSON array of reported addresses.  Any other content raises when it is
    read, so that a broken download never replaces a snapshot by nothing."""
    files = spark.read.format("binaryFile").load(path)
    if files.select("path").isEmpty():  # Spark leaves out files without content
        raise ValueError("blacklist file is no JSON array: it is empty")
    text = F.decode("content", "UTF-8")
    array = F.coalesce(F.from_json(text, "array<string>"), F.raise_error(
        F.lit("blacklist file is no JSON array")).cast("array<string>"))
    items = files.select(F.explode(array).alias("raw"))
    return _rows(items.select(
        F.lower(X.strip(F.col("raw"))).alias("address"), F.lit(S.ETHEREUM).alias("chain"),
        F.lit("reported address of a public blacklist").alias("entity_name"),
        F.lit(S.SCAM_REPORT).alias("category"), F.lit("medium").alias("confidence"))
        .filter("address <> ''"), source)


def best_tags(tags: DataFrame, order: str) -> DataFrame:
    """One row per address from (address, label, nameTag, ``order``): exchange
    before mixer before scam before other, then the first row of the file."""
    slug = F.lower(X.strip(F.col("label")))
    name = F.coalesce(F.when(X.strip(F.col("nameTag")) != "", X.strip(F.col("nameTag"))), slug)
    category = X.tag_category(slug, name)
    rank = F.when(category == S.EXCHANGE, 0).when(category == S.MIXER, 1) \
        .when(category == S.SCAM_REPORT, 2).otherwise(3)
    best = F.min_by(F.struct(category.alias("category"), name.alias("name"),
                             slug.alias("slug")), F.struct(rank, order))
    return tags.groupBy(F.lower(X.strip(F.col("address"))).alias("address")).agg(best.alias("b")) \
        .select("address", "b.*")


def load_explorer_tags(spark: SparkSession, path: str, source: str = "eth_labels",
                       multi_line: bool = False) -> DataFrame:
    """Explorer tag CSV, main network only, one best row per address.  Quotes
    inside a field are doubled; set ``multi_line`` for fields with line breaks
    (a file is then read by one task)."""
    raw = spark.read.option("header", "true").option("enforceSchema", "false").option(
        "escape", '"').option("multiLine", multi_line).schema(
        "address string, chainId string, label string, nameTag string").csv(path)
    # Position of a row: its file, its split, its place inside the split.
    place = raw.select("*", F.col("_metadata.file_path").alias("_f"),
                       F.col("_metadata.file_block_start").alias("_b"),
                       F.monotonically_increasing_id().alias("_i"))
    place = place.withColumn("ord", F.struct("_f", "_b", "_i"))
    good = place.filter((X.strip(F.col("chainId")) == EXPLORER_CHAIN_ID)
                        & X.strip(F.col("address")).startswith("0x")
                        & (F.length(X.strip(F.col("address"))) == 42))
    return explorer_labels(best_tags(good, "ord"), source)


def explorer_labels(best: DataFrame, source: str = "eth_labels") -> DataFrame:
    service = F.col("category").isin(S.EXCHANGE, S.MIXER)
    entity = F.when(service, F.concat("name", F.lit(" [explorer tag]"))) \
        .when(F.col("category") == S.SCAM_REPORT, F.concat(
            F.lit("explorer '"), "slug", F.lit("' tag: "), "name", F.lit(" (unverified)"))) \
        .otherwise(F.concat(F.lit("explorer tag: "), "name", F.lit(" ("), "slug",
                            F.lit(")")))
    return _rows(best.select(
        "address", F.lit(S.ETHEREUM).alias("chain"), entity.alias("entity_name"), "category",
        F.when(F.col("category") == "other", "low").otherwise("medium")
        .alias("confidence")), source)


def category_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))


def load_seed(spark: SparkSession, path: str, source: str = "seed_community") -> DataFrame:
    rows = _items(spark, path, "labels array<struct<address: string, chain: string, "
                  "entity: string, category: string>>", "labels", "seed file").select("item.*")
    return _rows(rows.select(
        X.norm_addr(F.col("address"), F.col("chain")).alias("address"), "chain",
        F.col("entity").alias("entity_name"), "category",
        F.lit("medium").alias("confidence")), source)


# ------------------------------------------------------ ordered directories

_COMPLIANCE = ("source_note string, designations array<struct<entity: string, "
               "status: string, note: string>>")
_CUSTODIANS = ("source_note string, custodians array<struct<entity: string, "
               "legal_name: string, jurisdiction: string, portal: string, "
               "guidelines: string, email: string, process_notes: string>>")


def _directory(spark, path, schema, column) -> DataFrame:
    return _items(spark, path, schema, column, "directory").select("ord", "item.*", "source_note")


def load_compliance(spark: SparkSession, path: str) -> DataFrame:
    return _directory(spark, path, _COMPLIANCE, "designations")


def load_custodians(spark: SparkSession, path: str, contains: str = "") -> DataFrame:
    out = _directory(spark, path, _CUSTODIANS, "custodians")
    if contains:
        needle = F.lit(contains.lower())
        out = out.filter(F.contains(F.lower(F.concat_ws(
            " ", "entity", "legal_name", "jurisdiction")), needle))
    return out


def directory_entries(directory: DataFrame) -> list[dict]:
    """A directory file as ordered constants for ``text.entity_match``.  It is
    hand-kept, and its size is checked before it reaches the driver."""
    rows = directory.orderBy("ord").limit(DIRECTORY_LIMIT + 1).collect()
    if len(rows) > DIRECTORY_LIMIT:
        raise ValueError(f"directory has more than {DIRECTORY_LIMIT} entries")
    return [r.asDict() for r in rows]
