"""Agency portfolio: enrich players from their transfers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import contains_any
from touchline.operators.aggregates import portfolio_summary


def enrich_players(players: DataFrame, transfers: DataFrame, home_words: list[str], paid_over: float = 0.0,
                   abroad_words: list[str] | None = None) -> DataFrame:
    """Career span, fees, peak value, date of joining the agency and first move abroad.

    ``transfers``: player_id, transfer_id, date, fee, is_loan, from_club, to_club. The agency is
    assumed to have run the latest paid move, else the latest permanent move.
    """
    loan = F.col("is_loan")
    kind = F.when((F.col("fee") > paid_over) & ~loan, 0).when(F.col("date").isNotNull() & ~loan, 1)
    method = F.when(kind == 0, "last_paid_transfer").otherwise("last_transfer")
    newest = F.max_by(F.when(kind.isNotNull(), F.struct("date", method.alias("method"))), F.when(kind.isNotNull(), F.struct(-kind, "date", -F.col("transfer_id"))))
    abroad = contains_any(F.col("from_club"), home_words) & F.col("to_club").isNotNull() & ~contains_any(F.col("to_club"), [*home_words, *(abroad_words or [])])
    first = F.min_by(F.when(abroad, F.struct("date", "to_club")), F.when(abroad, F.struct("date", "transfer_id")))
    # all that a player's moves tell is one aggregate: one scan and one shuffle of the transfers
    told = transfers.groupBy("player_id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.round(F.datediff(F.max("date"), F.min("date")) / 365.25, 1).alias("career_years"),
        F.max("fee").alias("peak_value"), F.sum("fee").alias("total_fees"), F.count("*").alias("n_transfers"), newest.alias("_since"), first.alias("_first"),
    )
    out = players.join(told, "player_id", "left")
    out = out.withColumns({
        "since_date": F.col("_since.date"), "method": F.col("_since.method"), "first_export_date": F.col("_first.date"), "first_export_club": F.col("_first.to_club"),
    }).drop("_since", "_first")
    return out.withColumn("method", F.coalesce("method", F.when(F.col("n_transfers").isNull(), "no_transfers").otherwise("no_moves")))


def agency_report(players: DataFrame, transfers: DataFrame, home_words: list[str], today) -> DataFrame:
    """Portfolio per agency, most valuable first. ``players`` also has birth_date, error."""
    clean = players.where(~F.coalesce("error", F.lit(False)))
    enriched = enrich_players(clean, transfers, home_words)
    out = portfolio_summary(
        enriched, "agency", "market_value", "total_fees", F.col("first_export_date").isNotNull(),
        F.datediff(today, F.col("birth_date")) / 365.25, F.col("since_date"), "name", "club",
    )
    return out.orderBy(F.col("total_mv").desc(), "agency")
