"""Evidence blocks of the three switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The blocks of each switch.
SWITCH_BLOCKS = {
    "liquidity": ("funding_price", "funding_confirmations", "backstop", "stock_quantity"),
    "positioning": ("volatility_term_structure", "trend_positioning", "options_tail_risk",
                    "cross_asset"),
    "fundamental": ("aggregate_acceleration", "orders_backlog", "prepayments_commitments",
                    "entity_breadth"),
}


def _block(
    name: str, available: Column, *, triggered: Column | None = None, status: Column,
    direction: Column, confidence: Column, closed: str = "UNAVAILABLE",
) -> Column:
    """A block; while unavailable it shows no trigger, direction or confidence."""
    a = F.coalesce(available, F.lit(False))
    no = F.lit(None).cast("boolean")
    return F.struct(
        F.lit(name).alias("block_id"), a.alias("available"),
        (no if triggered is None else F.when(a, triggered)).alias("triggered"),
        F.when(a, status).otherwise(closed).alias("status"),
        F.when(a, direction).otherwise("UNKNOWN").alias("direction"),
        F.when(a, confidence).otherwise("UNKNOWN").alias("confidence"),
    )


def _rows(df: DataFrame, switch: str, blocks: list[Column], keep: list[str]) -> DataFrame:
    return df.select(
        *keep, F.lit(switch).alias("switch_id"), F.explode(F.array(*blocks)).alias("b")
    ).select(*keep, "switch_id", "b.*")


def liquidity_blocks(alerts: DataFrame, *, keep: list[str]) -> DataFrame:
    """Blocks from a row of :func:`tiered_alert` plus price_ok, confirmations_ok,
    use_ok and stock_ok (health of the inputs) and use_days."""
    c = F.col
    price = F.coalesce(
        (c("latest") > c("watch_threshold")) | (c("positive_streak") >= c("streak_required")),
        F.lit(False),
    )
    n = c("confirmation_count")
    use = F.coalesce(c("use_days"), F.lit(0))
    blocks = [
        _block(
            "funding_price", c("price_ok"), triggered=price,
            status=F.when(price, "WATCH").otherwise("NORMAL"),
            direction=F.when(price, "TIGHTER").otherwise("STABLE"), confidence=c("confidence"),
        ),
        _block(
            "funding_confirmations", c("confirmations_ok"), triggered=n > 0,
            status=F.concat(n.cast("string"), F.lit("/3 UP")),
            direction=F.when(n > 0, "TIGHTER").otherwise("STABLE"), confidence=c("confidence"),
        ),
        _block(
            "backstop", c("use_ok"), triggered=use >= 2,
            status=F.concat(use.cast("string"), F.lit("/3 POSITIVE")),
            direction=F.when(use > 0, "MORE_USE").otherwise("FLAT"), confidence=c("confidence"),
        ),
        _block(
            "stock_quantity", c("stock_ok"), triggered=c("stock_stress"),
            status=F.when(c("stock_stress"), "P10 BREACH").otherwise("NO P10 BREACH"),
            direction=F.when(c("stock_stress"), "LOWER").otherwise("STABLE"),
            confidence=c("confidence"),
        ),
    ]
    return _rows(alerts, "liquidity", blocks, keep)


def positioning_blocks(inputs: DataFrame, *, keep: list[str]) -> DataFrame:
    """``inputs``: positions_ok and positions_direction (consensus of all series);
    the other blocks have no open source."""
    shut = F.lit(False)
    unknown = F.lit("UNKNOWN")

    def closed(name: str) -> Column:
        return _block(name, shut, status=unknown, direction=unknown, confidence=unknown,
                      closed="UNAVAILABLE_FREE")

    d = F.col("positions_direction")
    blocks = [
        closed("volatility_term_structure"),
        _block(
            "trend_positioning", F.col("positions_ok"), status=d, direction=d,
            confidence=F.lit("LOW"), closed="UNAVAILABLE_FREE",
        ),
        closed("options_tail_risk"), closed("cross_asset"),
    ]
    return _rows(inputs, "positioning", blocks, keep)


def fundamental_blocks(inputs: DataFrame, *, keep: list[str]) -> DataFrame:
    """``inputs``: automated_ok, aggregate_direction, entity_direction, and for
    orders and commitments: <b>_active, <b>_healthy, <b>_direction."""
    c = F.col
    medium = F.lit("MEDIUM")

    def reviewed(name: str, prefix: str) -> Column:
        ok = c(f"{prefix}_active") & c(f"{prefix}_healthy")
        block = _block(name, ok, status=c(f"{prefix}_direction"),
                       direction=c(f"{prefix}_direction"), confidence=medium)
        shown = (
            F.when(F.coalesce(ok, F.lit(False)), c(f"{prefix}_direction"))
            .when(F.coalesce(c(f"{prefix}_active"), F.lit(False)), "STALE")
            .otherwise("MANUAL_READY")
        )
        return block.withField("status", shown)

    blocks = [
        _block(
            "aggregate_acceleration", c("automated_ok"), status=c("aggregate_direction"),
            direction=c("aggregate_direction"), confidence=medium,
        ),
        reviewed("orders_backlog", "orders"),
        reviewed("prepayments_commitments", "commitments"),
        _block(
            "entity_breadth", c("automated_ok"), status=c("entity_direction"),
            direction=c("entity_direction"), confidence=medium,
        ),
    ]
    return _rows(inputs, "fundamental", blocks, keep)


def default_blocks(entities: DataFrame, switch: str, *, keep: list[str]) -> DataFrame:
    """The blocks of a switch that is not open yet: all unavailable, all null."""
    unknown = F.lit("UNKNOWN")
    blocks = [
        _block(name, F.lit(False), status=unknown, direction=unknown, confidence=unknown,
               closed="UNAVAILABLE_FREE")
        for name in SWITCH_BLOCKS[switch]
    ]
    return _rows(entities, switch, blocks, keep)
