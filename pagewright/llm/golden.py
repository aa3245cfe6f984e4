"""Golden records (op12): survivorship by a pivot over sources, with DataFrame functions only.

One conditional aggregation over a cluster keeps, for each field and each level of trust, the latest
record that has a value. Whether a record is fresh depends on the cluster's latest time, which the same
aggregation finds; of one level the latest record is fresh if any is, so fresh candidates are coalesced down the trust
ladder first and stale ones after them.

What needs the cluster's results for each of its records (how many are stale, balances of the chosen segment) is a second
aggregation over the records joined with the written results of the first. A cluster with a thousandth of all records
or more is joined by broadcast: there are at most a thousand such, whatever the input. All others are joined by a
shuffle on the cluster, in which none of them weighs much. Both aggregations combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .scratch import Scratch

#: Sources by falling trust. All others, and none, come after them.
TRUST = ("crm", "web", "store", "partner")
FRESH_HOURS = 60 * 24
BLANK = r"^[\x20\x09-\x0D]*\z"
#: A cluster that holds this part of all records is joined by broadcast; so there are at most as many of these.
HOT = 1000
TEXTS = ("name", "email", "city", "segment", "source")


def _records(clients: DataFrame, trust: Sequence[str]) -> DataFrame:
    """cluster_id, level (0: most trusted), updated_at, client_id and the fields; blank strings are null."""
    text = {c: F.when(~F.rlike(F.col(quoted(c)), F.lit(BLANK)), F.col(quoted(c))) for c in TEXTS}
    level = F.lit(len(trust))
    for i, source in enumerate(trust):
        level = F.when(text["source"] == source, i).otherwise(level)
    balance = F.col("balance").cast("double")
    finite = ~F.isnan(balance) & (F.abs(balance) != float("inf"))
    return clients.select(
        F.coalesce("master_id", "client_id").cast("long").alias("cluster_id"), level.alias("level"), "updated_at", F.col("client_id").cast("long").alias("client_id"), *(text[c].alias(c) for c in TEXTS if c != "source"),
        "nation_id", F.when(finite, balance).alias("balance"))


def _newer() -> list[Column]:
    """Larger: later, null first; then a smaller client_id, null last."""
    return [F.col("updated_at"), F.bitwise_not(F.col("client_id")).alias("before")]


def _candidates(there: Column, values: Sequence[Column], levels: int, first: Column | None = None) -> Column:
    """For each level of trust its best record where ``there`` holds: by ``first``, then the latest; equal ones by the values."""
    found = [F.max(F.when(there & (F.col("level") == i), F.struct((F.lit(0) if first is None else first).alias("first"), *_newer(), *values, F.col("client_id").alias("client")))) for i in range(levels)]
    return F.array(*found)


def _down(candidates: Column, levels: int, holds: Callable[[Column], Column]) -> Column:
    """The first candidate down the trust ladder that ``holds``."""
    return F.coalesce(*(F.when(holds(candidates[i]), candidates[i]) for i in range(levels)))


def _trusted(candidates: Column, levels: int, oldest: Column) -> Column:
    """Of the candidates with the largest ``first``: fresh before stale, then by trust."""
    best = F.array_max(F.transform(candidates, lambda c: c["first"]))
    top = lambda c: c["first"] == best
    return F.coalesce(_down(candidates, levels, lambda c: top(c) & (c["updated_at"] >= oldest)), _down(candidates, levels, top))


def _recent(candidates: Column, levels: int) -> Column:
    """The latest candidate; of equal times, by trust."""
    last = F.array_max(F.transform(candidates, lambda c: c["updated_at"]))
    return _down(candidates, levels, lambda c: c.isNotNull() & c["updated_at"].eqNullSafe(last))


def golden_records(clients: DataFrame, *, trust: Sequence[str] = TRUST, fresh_hours: int = FRESH_HOURS) -> DataFrame:
    """One row per cluster (master_id, if null client_id): cluster_id, n_records, n_stale, name, email, segment, city, nation_id, balance, and the client_id that each came from (name_from, ...).

    ``clients``: client_id, master_id, source, updated_at, name, email, city, nation_id, segment, balance; others are ignored, whatever their names.

    Blank strings count as null; others stay as they are. A balance that is no finite number counts as null. A record is stale if its time is null or more than ``fresh_hours`` before its
    cluster's latest. RECENT: latest first, null last, then trust, then the smaller client_id (null last). TRUSTED: fresh first, then trust, then RECENT. segment by RECENT; email by TRUSTED; name by most code points, then
    TRUSTED; balance of the chosen segment's records first, then by RECENT; city and nation_id from one record: most non-nulls of both, then TRUSTED. Records alike in all
    of this: the larger value, so rows that repeat change n_records and n_stale only. Records with neither id are one cluster, whose id is null. Sources that are
    unknown, null or blank are least trusted. An empty table gives an empty result; very long strings are kept whole.
    """
    scratch, levels = Scratch(clients.sparkSession, "golden"), len(trust) + 1
    records = _records(clients, trust)
    address = F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")
    pivot = records.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_records"), F.max("updated_at").alias("latest"),
        _candidates(F.col("segment").isNotNull(), [F.col("segment").alias("v")], levels).alias("segments"),
        _candidates(F.col("email").isNotNull(), [F.col("email").alias("v")], levels).alias("emails"),
        _candidates(F.col("name").isNotNull(), [F.col("name").alias("v")], levels, F.length("name")).alias("names"),
        _candidates(address > 0, [F.col("city"), F.col("nation_id")], levels, address).alias("addresses"))
    oldest = F.col("latest") - F.make_dt_interval(hours=F.lit(fresh_hours))
    chosen = pivot.withColumn("oldest", oldest).select(
        "cluster_id", "n_records", "oldest", _recent(F.col("segments"), levels).alias("s"), _trusted(F.col("emails"), levels, F.col("oldest")).alias("e"),
        _trusted(F.col("names"), levels, F.col("oldest")).alias("n"), _trusted(F.col("addresses"), levels, F.col("oldest")).alias("a"))
    first = scratch.save(chosen.select(
        "cluster_id", "n_records", "oldest", F.col("n.v").alias("name"), F.col("e.v").alias("email"), F.col("s.v").alias("segment"), "a.city", "a.nation_id",
        F.col("n.client").alias("name_from"), F.col("e.client").alias("email_from"), F.col("s.client").alias("segment_from"), F.col("a.client").alias("address_from")), "first")
    second = _second(records, first, scratch, levels)
    balance = F.coalesce(_recent(F.col("inside"), levels), _recent(F.col("outside"), levels))
    found = first.hint("merge").join(second, F.col("cluster_id").eqNullSafe(F.col("cluster"))).withColumn("b", balance)
    return found.select("cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", F.col("b.v").alias("balance"),
                        "name_from", "email_from", "segment_from", F.col("b.client").alias("balance_from"), "address_from")


def _second(records: DataFrame, first: DataFrame, scratch: Scratch, levels: int) -> DataFrame:
    """cluster, n_stale and the candidates for the balance, of records of the chosen segment and of all others."""
    total = first.agg(F.sum("n_records")).first()[0] or 0
    known = first.select(F.col("cluster_id").alias("cluster"), F.col("segment").alias("chosen"), "oldest", (F.col("n_records") * HOT >= total).alias("hot"))
    hot = F.broadcast(known.where("hot"))  # at most HOT rows: each has that part of all records
    rows = records.select("cluster_id", "level", "updated_at", "client_id", "segment", "balance")
    same = F.col("cluster_id").eqNullSafe(F.col("cluster"))
    given, inside = F.col("balance").isNotNull(), F.col("segment").eqNullSafe(F.col("chosen"))
    value = [F.col("balance").alias("v")]

    def summed(joined: DataFrame) -> DataFrame:
        stale = F.col("updated_at").isNull() | (F.col("updated_at") < F.col("oldest"))
        return joined.groupBy("cluster").agg(F.count_if(stale).alias("n_stale"), _candidates(given & inside, value, levels).alias("inside"), _candidates(given & ~inside, value, levels).alias("outside"))

    cold = rows.join(hot, same, "left_anti").join(known.where("not hot").hint("merge"), same)
    return summed(cold).unionByName(summed(rows.join(hot, same)))
