"""Labels of an address reduced to one row of facts, and the role they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions.text import conf_rank, norm_addr

KEY = ["chain", "address"]


def merge_flags(labels: DataFrame, flags: DataFrame | None) -> DataFrame:
    """Labels with the agency's own flags added as high-confidence labels."""
    cols = ["address", "chain", "entity_name", "category", "source", "confidence"]
    if flags is None:
        return labels.select(*cols)
    reason = F.col("reason")
    text = F.when(F.coalesce(reason, F.lit("")) == "", F.lit("AGENCY FLAG")) \
        .otherwise(F.concat(F.lit("AGENCY FLAG: "), reason))
    own = flags.select("address", "chain", text.alias("entity_name"),
                       F.lit(S.FLAGGED).alias("category"),
                       F.lit("agency_flag").alias("source"),
                       F.lit("high").alias("confidence"))
    return labels.select(*cols).unionByName(own)


def attach_labels(addresses: DataFrame, labels: DataFrame,
                  flags: DataFrame | None = None) -> DataFrame:
    """One row per address and label, best confidence first (``label_no``).

    Labels are keyed by (address, chain, source), so an address has at most
    one per source and the numbering never sees a large group."""
    from pyspark.sql import Window
    ranked = merge_flags(labels, flags).withColumn("_r", conf_rank(F.col("confidence")))
    order = Window.partitionBy(*KEY).orderBy("_r", "source", "entity_name")
    ranked = ranked.withColumn("label_no", F.row_number().over(order)).drop("_r")
    keyed = addresses.withColumn("address", norm_addr(F.col("address"), F.col("chain")))
    return keyed.join(ranked, KEY, "left")


def address_facts(labels: DataFrame, flags: DataFrame | None = None,
                  contracts: DataFrame | None = None,
                  activity: DataFrame | None = None,
                  activity_above: int | None = None) -> DataFrame:
    """One row per address about which anything is known.

    ``activity`` (chain, address, activity) is cut to addresses above the
    threshold first, so the result grows with the labels, not the ledger.
    """
    all_labels = merge_flags(labels, flags)
    rank = F.struct(conf_rank(F.col("confidence")).alias("r"),
                    F.col("source").alias("s"), F.col("entity_name").alias("e"))
    label = F.struct("entity_name", "category", "source", "confidence")

    def best(category=None):
        if category is None:
            return F.min_by(label, rank)
        return F.min_by(label, F.when(F.col("category") == category, rank))

    def has(category):
        return F.max(F.col("category") == category)
    by_label = all_labels.groupBy(*KEY).agg(
        has(S.SANCTIONED).alias("is_sanctioned"), has(S.MIXER).alias("is_mixer"),
        has(S.EXCHANGE).alias("is_exchange"), has(S.FLAGGED).alias("agency_flagged"),
        has(S.SHARED_FLAG).alias("shared_flagged"),
        has(S.SCAM_REPORT).alias("scam_reported"),
        best().alias("label"), best(S.EXCHANGE).alias("exchange_label"),
        best(S.MIXER).alias("mixer_label"), best(S.SANCTIONED).alias("sanction_label"),
        best(S.SCAM_REPORT).alias("scam_label"))
    # min_by ignores null orderings only when a non-null one exists.
    for cat, flag, col in ((S.EXCHANGE, "is_exchange", "exchange_label"),
                           (S.MIXER, "is_mixer", "mixer_label"),
                           (S.SANCTIONED, "is_sanctioned", "sanction_label"),
                           (S.SCAM_REPORT, "scam_reported", "scam_label")):
        by_label = by_label.withColumn(col, F.when(F.col(flag), F.col(col)))
    out = by_label
    if contracts is not None:
        marked = contracts.select(*KEY).distinct().withColumn("is_contract", F.lit(True))
        out = out.join(marked, KEY, "full")
    else:
        out = out.withColumn("is_contract", F.lit(False))
    if activity is not None:
        busy = activity.select(*KEY, "activity")
        if activity_above is not None:
            busy = busy.filter(F.col("activity") > activity_above)
        out = out.join(busy, KEY, "full")
    else:
        out = out.withColumn("activity", F.lit(None).cast("bigint"))
    booleans = ["is_sanctioned", "is_mixer", "is_exchange", "agency_flagged",
                "shared_flagged", "scam_reported", "is_contract"]
    return out.na.fill(False, booleans)


def role_of(high_activity: int | None) -> Column:
    """Role before expansion; the first rule that holds wins."""
    c = F.col
    busy = F.coalesce(c("activity") > high_activity, F.lit(False)) \
        if high_activity is not None else F.lit(False)
    return (F.when(c("is_sanctioned"), S.SANCTIONED).when(c("is_mixer"), S.MIXER)
            .when(c("is_exchange"), S.EXCHANGE).when(c("is_contract"), S.CONTRACT)
            .when(busy, S.HIGH_ACTIVITY).otherwise(S.INTERMEDIARY))


def basis_of() -> Column:
    """Why a node has its role, in one line naming source and confidence."""
    c = F.col

    def by(column, lead):
        return F.concat(F.lit(lead), c(f"{column}.entity_name"), F.lit(" (source "),
                        c(f"{column}.source"), F.lit(", confidence "),
                        c(f"{column}.confidence"), F.lit(")"))
    return (F.when(c("role") == S.VICTIM, F.lit("start wallet"))
            .when(c("role") == S.SANCTIONED, by("sanction_label", "sanctions list: "))
            .when(c("role") == S.MIXER, by("mixer_label", "mixing service: "))
            .when(c("role") == S.EXCHANGE, by("exchange_label", "custodian: "))
            .when(c("role") == S.CONTRACT, F.lit("holds contract code; not followed"))
            .when(c("role") == S.HIGH_ACTIVITY, F.concat(
                F.lit("heuristic, low confidence: "), c("activity").cast("string"),
                F.lit(" transactions; not followed")))
            .when(c("role") == S.UNEXPANDED, F.lit("limit reached; not examined"))
            .otherwise(F.lit("passed through; no label")))


FACT_COLUMNS = ("is_sanctioned", "is_mixer", "is_exchange", "agency_flagged",
                "shared_flagged", "scam_reported", "is_contract", "activity",
                "label", "exchange_label", "mixer_label", "sanction_label",
                "scam_label")


def classify(nodes: DataFrame, facts: DataFrame,
             high_activity: int | None) -> DataFrame:
    """Attach facts to nodes keyed by (chain, address) and give the role."""
    booleans = FACT_COLUMNS[:7]
    return nodes.join(facts.select(*KEY, *FACT_COLUMNS), KEY, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in booleans}
    ).withColumn("role", role_of(high_activity))
