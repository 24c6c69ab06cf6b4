"""Filing path: index rows and documents to the windowed ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.clean import canonical_alias_row
from seriesloom.operators.joins import link_amendments, reuse_known
from seriesloom.sources.filings import _typed, filing_summary


def filings_to_parse(index_rows: DataFrame, known: DataFrame) -> DataFrame:
    """Index rows folded to one per filing, with what is new, reused or different."""
    folded = canonical_alias_row(index_rows.where("problem IS NULL"))
    return reuse_known(folded.where(~F.col("is_conflict")).drop("is_conflict"), known)


def ledger_entries(parsed: DataFrame) -> DataFrame:
    """Ledger rows from parsed documents (``parse_ownership_docs``).

    The plan flag belongs to the filing, so the FALSE bucket of a filing is
    either all of its transactions or none of them.
    """
    ledger = filing_summary(parsed.where("problem IS NULL").drop("problem")).drop("owners")
    false = F.col("flag") == "FALSE"
    return ledger.select(
        "*",
        *[
            F.when(false, F.col(c)).otherwise(0).alias(f"false_{c}")
            for c in ("buy_count", "sell_count", "eligible_count")
        ],
    )


def audit_rows(parsed: DataFrame) -> DataFrame:
    """Failures and reviews of parsed documents: index_date, accession, stage, reason.

    All of a document come from its own row, so it is parsed once.
    """
    failed, anomalies = F.col("problem").isNotNull(), F.col("metadata_anomalies")

    def found(stage: str, reason: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), reason.alias("reason"))

    rows = _typed(parsed)
    numbered = F.transform("_t", lambda t, i: F.when(t["status"] == "QUARANTINED", i + 1))
    quarantined = F.transform(
        F.array_compact(numbered),
        lambda n: found("TRANSACTION_QUARANTINE", F.format_string("NONDERIVATIVE_ROW_%d_QUARANTINED", n)),
    )
    none = F.array().cast("array<struct<stage:string,reason:string>>")
    dated = F.when(F.size(anomalies) > 0, F.array(found("METADATA_DATE_ANOMALY", F.array_join(anomalies, ",")))).otherwise(none)
    listed = F.when(failed, F.array(found("SUBMISSION", F.col("problem")))).otherwise(
        F.concat(F.coalesce(quarantined, none), dated)
    )
    return rows.select("accession", "index_date", F.inline(listed))


def resolve_ledger(
    ledger: DataFrame, *, identity: Sequence[str] = ("issuer", "period", "owner_hash",
                                                     "transactions_hash"),
) -> DataFrame:
    """Ledger rows with amendment status; identical transactions are recognised
    by the hash over their sorted fingerprints."""
    return link_amendments(
        ledger, base_form="4", amended_form="4/A", filed="filed", original_date="original_date",
        identity=identity,
    ).withColumn("is_amendment", F.col("form") == "4/A")
