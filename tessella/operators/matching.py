"""One-to-one matches of largest total weight, by an auction in which prices are a table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Rows of a group that one task bids for.
ROWS = 20_000


def bid(pairs: list[tuple[np.ndarray, np.ndarray]], price: np.ndarray, owner: np.ndarray, eps: int) -> None:
    """Let rows without a column bid until all have one: each takes its best column and raises its price to where the second best is as good, and by ``eps``.

    ``pairs`` has for each row its columns and their worth. ``price`` and
    ``owner`` (-1 for rows elsewhere, or none) change in place.
    """
    held = set(owner[owner >= 0].tolist())
    waiting = [r for r in range(len(pairs)) if r not in held][::-1]
    while waiting:
        r = waiting.pop()
        at, worth = pairs[r]
        gain = worth - price[at]
        k = int(gain.argmax())
        best, gain[k] = int(gain[k]), np.iinfo(np.int64).min
        second = int(gain.max()) if len(gain) > 1 else best
        j = at[k]
        if owner[j] >= 0:
            waiting.append(int(owner[j]))
        owner[j] = r
        price[j] += best - second + eps


def auction(weights: DataFrame, row: str, col: str, weight: str, by: Sequence[str] = (), unit: float = 1e-6, blocks: int | None = None, rounds: int = 1000) -> DataFrame:
    """For each row of a group one column, for each column one row at most, of largest total weight: ``by, row, col, weight``.

    Weights are counted in whole ``unit``s; in these the result is exact. Pairs
    that are not in the table cannot be matched; all pairs of a group whose rows
    are as many as its columns let prices start from coarse auctions, otherwise there is one
    fine auction from prices of zero.

    Rows of a group are dealt to ``blocks`` tasks. A task knows the prices of its
    group's columns and lets its own rows bid until each has a column. Of the bids
    for a column the highest stays, the first row of equals; rows that lose bid
    again in the next round. As prices only rise, a row's column is within a
    step of its best one at any time, also where others' prices were old when
    it bid; with a step below one unit for all rows together the total is the largest.
    Each round writes the prices, so a lost executor costs a round. Null weights do not
    count; groups with more rows than columns raise an error.
    """
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    own = weights.select(*keys, F.col(row).alias("_r"), F.col(col).alias("_c"), F.round(F.col(weight) / unit).cast("long").alias("_w")).filter("_r IS NOT NULL AND _c IS NOT NULL AND _w IS NOT NULL").groupBy(*names, "_r", "_c").agg(F.max("_w").alias("_w"))
    own = staged(own)
    sizes = own.groupBy(*names).agg(F.countDistinct("_r").alias("rows"), F.countDistinct("_c").alias("cols"), F.count(F.lit(1)).alias("pairs"), (F.max("_w") - F.min("_w")).alias("range"))
    most, wide, full, far = sizes.agg(F.max("rows"), F.max(F.col("rows") - F.col("cols")), F.min((F.col("rows") == F.col("cols")) & (F.col("pairs") == F.col("rows") * F.col("cols"))), F.max("range")).head()
    kinds = {c: own.schema[c].dataType.simpleString() for c in (*names, "_r", "_c")}
    out_names = [*by, row, col, weight]
    if not most:
        return weights.limit(0).select(*out_names)
    if wide > 0:
        raise ValueError("a group has more rows than columns")
    blocks = blocks or -(-most // ROWS)
    scale = most + 1  # a step of one is then below a unit for all rows of a group together
    table = own.withColumn("_b", F.pmod(F.xxhash64("_r"), F.lit(blocks)).cast("int")).withColumn("_w", F.col("_w") * scale)
    table = staged(table)
    state = staged(own.select(*names, "_c").distinct().select(*names, "_c", F.lit(0).cast("long").alias("price"), F.lit(None).cast(kinds["_r"]).alias("owner")))
    n_rows = own.select(*names, "_r").distinct().count()
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), f"_c {kinds['_c']}", "price long", f"owner {kinds['_r']}"])

    def bidding(eps: int):
        def run(pairs: pd.DataFrame, prices: pd.DataFrame) -> pd.DataFrame:
            if not len(pairs):
                return prices.iloc[:0][[*names, "_c", "price", "owner"]]
            prices = prices.reset_index(drop=True)
            place = {c: i for i, c in enumerate(prices["_c"])}
            rows, found = [], []
            for r, x in pairs.groupby("_r", sort=True):
                rows.append(r)
                x = x.sort_values("_c")
                found.append((np.array([place[c] for c in x["_c"]]), x["_w"].to_numpy(np.int64)))
            of = {r: i for i, r in enumerate(rows)}
            price = prices["price"].to_numpy(np.int64).copy()
            owner = np.array([of.get(r, -1) for r in prices["owner"]], np.int64)
            before = price.copy()
            bid(found, price, owner, eps)
            new = np.flatnonzero((price > before) & (owner >= 0))
            return prices.iloc[new][[*names, "_c"]].assign(price=price[new], owner=[rows[owner[j]] for j in new])

        return run

    step = max(1, far * scale // 4) if full else 1
    while True:
        if step < max(1, far * scale // 4):  # a finer auction keeps the prices alone
            state = staged(state.withColumn("owner", F.lit(None).cast(kinds["_r"])))
        for _ in range(rounds):
            # keys of prices are repeated for each block of rows
            told = state.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            bids = table.groupBy(*names, "_b").cogroup(told.groupBy(*names, "_b")).applyInPandas(bidding(step), schema)
            best = bids.groupBy(*names, "_c").agg(F.max("price").alias("bid"), F.min(F.struct((-F.col("price")).alias("p"), F.col("owner").alias("r"))).alias("x")).select(*[F.col(c).alias(f"{c}x") for c in names], F.col("_c").alias("_cx"), "bid", F.col("x.r").alias("bidder"))
            same = F.col("_c") == F.col("_cx")
            for c in names:
                same = same & F.col(c).eqNullSafe(F.col(f"{c}x"))
            state = staged(state.join(best, same, "left").select(*names, "_c", F.coalesce("bid", "price").alias("price"), F.coalesce("bidder", "owner").alias("owner")))
            if state.filter("owner IS NOT NULL").count() == n_rows:
                break
        else:
            raise ValueError(f"no end of bids in {rounds} rounds")
        if step == 1:
            break
        step = max(1, step // 64)
    done = state.filter("owner IS NOT NULL").select(*[F.col(c).alias(f"{c}x") for c in names], F.col("_c").alias("_cx"), "owner")
    same = (F.col("_c") == F.col("_cx")) & (F.col("_r") == F.col("owner"))
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}x"))
    return own.join(done, same).select(*[F.col(c).alias(k) for c, k in zip(names, by, strict=True)], F.col("_r").alias(row), F.col("_c").alias(col), (F.col("_w") * unit).alias(weight))
