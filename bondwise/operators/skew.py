"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with at least this many rows counts as a hub. Hubs number at most n_facts / HUB_ROWS, which is the
# proven bound on what is broadcast below.
HUB_ROWS = 1_000_000
MAX_HUBS = 20_000


def hub_join(facts: DataFrame, per_key: DataFrame, key: str | list[str], n_facts: int | None, how: str = "inner", parts: int | None = None) -> DataFrame:
    """Join many ``facts`` to one ``per_key`` row each, where ``per_key`` has ``deg``, the key's fact count.

    Rows of hub keys join by broadcast in place and never meet in one task; all others take a shuffle join.
    No key can be a hub when there are fewer facts than HUB_ROWS, and then one plain join is planned. Without
    ``n_facts`` the hubs are looked for in every case. ``parts`` fixes the number of tasks among which the other rows are dealt.
    """
    floor = max(HUB_ROWS, (n_facts or 0) // MAX_HUBS)
    slim = per_key.drop("deg")
    keys = [key] if isinstance(key, str) else key
    dealt = lambda rows: rows.repartition(parts, *keys) if parts else rows
    if n_facts is not None and n_facts < floor:
        return dealt(facts).join(slim, key, how)
    hubs = per_key.filter(F.col("deg") >= floor)
    hub_keys = F.broadcast(hubs.select(*keys))
    hot = facts.join(F.broadcast(hubs.drop("deg")), key)
    cold = dealt(facts.join(hub_keys, key, "left_anti")).join(per_key.filter(F.col("deg") < floor).drop("deg"), key, how)
    return hot.unionByName(cold)
