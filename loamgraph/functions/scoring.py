"""Scores as column expressions. Times are compared with an explicit as_of, never with the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The defaults of the retrieval settings.
WEIGHTS = {"vector": 0.30, "text": 0.20, "recency": 0.15, "activation": 0.20, "importance": 0.15}
HALF_LIFE_HOURS, ACT_DECAY, ACT_EXPONENT = 168.0, 0.5, 0.5
STM_WINDOW_HOURS, STM_BOOST = 2.0, 1.5
SUPERSEDED, SUPERSEDING = 0.5, 1.2
CONSOLIDATED, UNCONSOLIDATED = 0.5, 1.3
NEIGHBOUR_FACTOR, SPREAD_DECAY, BONUS_WEIGHT = 0.6, 0.6, 0.1
REINFORCE_DELTA, WEIGHT_FLOOR, WEIGHT_CEILING = 0.05, 0.1, 1.5
MICRO_DECAY, STALE_DECAY, STALE_HOURS = 0.998, 0.95, 48


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def hours_since(ts: Column, as_of: str) -> Column:
    """Hours from ts to as_of, 0 if ts is later; null stays null."""
    h = (F.unix_micros(at(as_of)) - F.unix_micros(ts)) / F.lit(3.6e9)
    return F.when(h.isNotNull(), F.greatest(h, F.lit(0.0)))


def recency(ts: Column, as_of: str, half_life: float = HALF_LIFE_HOURS) -> Column:
    return F.pow(F.lit(2.0), -hours_since(ts, as_of) / half_life)


def activation(count: Column, last: Column, as_of: str) -> Column:
    """sigmoid(ln(n^a + 1) - d ln(hours + 1)); a node never accessed is taken as accessed now."""
    h = F.coalesce(hours_since(last, as_of), F.lit(0.0))
    raw = F.ln(F.pow(F.coalesce(count, F.lit(0)).cast("double"), F.lit(ACT_EXPONENT)) + 1) - ACT_DECAY * F.ln(h + 1)
    return 1 / (1 + F.exp(-raw))


def stm_boost(ts: Column, as_of: str, window: float = STM_WINDOW_HOURS, boost: float = STM_BOOST) -> Column:
    """boost at age 0, falling in a line to 1 at the window's end."""
    if window <= 0 or boost <= 1:
        return F.lit(1.0)
    h = hours_since(ts, as_of)
    return F.when(h >= window, 1.0).otherwise(1 + (boost - 1) * (1 - h / window))


def hybrid(weights: dict[str, float] | None = None, **signals: Column) -> Column:
    """Weighted mean of the signals that are not null; 0 if none is. A signal of 0 keeps its weight."""
    w = weights or WEIGHTS
    top, low = F.lit(0.0), F.lit(0.0)
    for k, v in signals.items():
        top = top + F.when(v.isNotNull(), w[k] * v).otherwise(0.0)
        low = low + F.when(v.isNotNull(), w[k]).otherwise(0.0)
    return F.when(low > 0, top / low).otherwise(0.0)


def supersession(is_target: Column, is_source: Column) -> Column:
    """A superseded item counts half, even if it supersedes another one; a superseding one a fifth more."""
    return F.when(is_target, SUPERSEDED).when(is_source, SUPERSEDING).otherwise(1.0)


def reinforced(weight: Column, delta: float = REINFORCE_DELTA, ceiling: float = WEIGHT_CEILING) -> Column:
    """least(w + delta / (1 + 5 (w - 1)), ceiling). The divisor is not positive for w <= 0.8: such weights grow by delta."""
    slow = 1 + (weight - 1) * 5
    return F.least(weight + F.when(slow > 1e-9, delta / slow).otherwise(delta), F.lit(ceiling))


def decayed(weight: Column, factor: float, floor: float = WEIGHT_FLOOR) -> Column:
    """The weight times factor, not below floor; weights at or under the floor stay as they are."""
    return F.when(weight > floor, F.greatest(weight * factor, F.lit(floor))).otherwise(weight)
