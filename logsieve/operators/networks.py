"""Lists of trusted addresses and networks: one look-up by disjoint intervals, and the statements that change the list.

An IPv4 address is a number and a network an interval of numbers. Intervals are cut at blocks of 2^16 addresses and
merged inside each, so a block's are disjoint and sorted; there are at most 65,536 blocks, however long the list. An
address is looked up by one equi-join on its block and a binary search among the block's intervals, whatever the
prefix lengths in use.

Defined results: entries that are no IPv4 address or network are passed over by the look-up, and ``refused`` names
them; a null or malformed address is trusted by nothing; an empty list trusts nothing; entries may repeat and overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.functions import http
from logsieve.functions import text as t
from logsieve.operators.patterns import BROADCAST_ROWS
from logsieve.sources.tables import cut

BITS = 16
CIDR = http.IPV4.removesuffix("$") + r"/(?:3[0-2]|[12]?\d)$"


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null where it is none."""
    p = F.split(ip, "\\.")
    value = sum((F.get(p, i).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(t.matches(ip, http.IPV4), value)


def blocks(listed: DataFrame) -> DataFrame:
    """``listed`` (ip_address, cidr; the network counts where both are given) as one row for each block: block, firsts and lasts (sorted, of the same length; places in the block)."""
    net = listed.select(F.coalesce(F.nullif("cidr", F.lit("")), F.concat("ip_address", F.lit("/32"))).alias("cidr")).where(t.matches(F.col("cidr"), CIDR))
    net = net.select(ip_number(F.substring_index("cidr", "/", 1)).alias("n"), F.substring_index("cidr", "/", -1).cast("int").alias("bits")).withColumn("size", F.expr("shiftleft(1L, 32 - bits)"))
    net = net.select((F.col("n") - F.col("n") % F.col("size")).alias("first"), "size").distinct().select("first", (F.col("first") + F.col("size") - 1).alias("last"))
    each = net.select("*", F.explode(F.sequence(F.shiftright("first", BITS), F.shiftright("last", BITS))).alias("block"))
    start = F.expr(f"shiftleft(block, {BITS})")
    each = each.select("block", (F.greatest("first", start) - start).cast("int").alias("first"), F.least(F.col("last") - start, F.lit((1 << BITS) - 1)).cast("int").alias("last")).distinct()
    order = Window.partitionBy("block").orderBy("first", F.desc("last"))
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("new", (F.col("first") > F.coalesce(reach, F.lit(-2)) + 1).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = each.groupBy("block", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    held = runs.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    return held.select("block", F.col("runs.first").alias("firsts"), F.col("runs.last").alias("lasts"))


def _inside(place: Column) -> Column:
    """Whether one of a block's intervals (firsts, lasts) holds a place: the number of firsts up to it by halving steps, then the last of that one."""
    steps = F.sequence(F.floor(F.log2(F.size("firsts").cast("double"))).cast("int"), F.lit(0), F.lit(-1))
    up = lambda at, s: at + F.call_function("shiftleft", F.lit(1), s)
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get("firsts", up(at, s) - 1) <= place, up(at, s)).otherwise(at))
    return F.coalesce(F.get("lasts", found - 1) >= place, F.lit(False))


def with_trust(events: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """``events`` with ``trusted``: whether the address in ``column`` is listed or lies in a listed network.

    Blocks are broadcast if they hold few intervals (counted), so that the events are not shuffled. Of more, the
    events' distinct addresses are looked up (a block has at most 2^16 of them) and only events that have an
    address are joined to what is found.
    """
    table = blocks(listed)
    number = ip_number(F.col(column))
    few = (table.agg(F.sum(F.size("firsts"))).first()[0] or 0) <= BROADCAST_ROWS
    ask = lambda rows, of: rows.join(of, "block", "left").withColumn("trusted", _inside((F.col("_n") % (1 << BITS)).cast("int"))).drop("block", "firsts", "lasts", "_n")
    numbered = lambda rows: rows.withColumn("_n", number).withColumn("block", F.shiftright("_n", BITS))
    if few:
        clash = [c for c in ("block", "firsts", "lasts") if c in events.columns]
        if not clash:
            return ask(numbered(events), F.broadcast(table))
        hidden = events.withColumnsRenamed({c: f"__{c}" for c in clash})
        return ask(numbered(hidden), F.broadcast(table)).withColumnsRenamed({f"__{c}": c for c in clash}).select(*events.columns, "trusted")
    seen = numbered(events.select(column).where(number.isNotNull()).distinct())
    hits = ask(seen, cut(table, "networks")).where("trusted").select(F.col(column).alias("_ip")).withColumn("_hit", F.lit(True))
    known = events.where(number.isNotNull()).join(hits, F.col(column) == F.col("_ip"), "left").withColumn("trusted", F.coalesce("_hit", F.lit(False))).drop("_ip", "_hit")
    return known.unionByName(events.where(number.isNull()).withColumn("trusted", F.lit(False)))


def refused(new: DataFrame, listed: DataFrame) -> DataFrame:
    """``new`` (id, ip_address, cidr, ...) with ``fault``: why an entry cannot be added to ``listed``; null where it can.

    Of valid new entries of one address or one network the first by id counts, the others are already trusted.
    """
    ip, net = F.coalesce("ip_address", F.lit("")), F.coalesce("cidr", F.lit(""))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    own = (
        F.when((ip == "") & (net == ""), "either ip_address or cidr must be provided")
        .when((net != "") & ~t.matches(net, CIDR), F.concat(F.lit("invalid CIDR "), q(net)))
        .when((ip != "") & ~t.matches(ip, http.IPV4), F.concat(F.lit("invalid IP address "), q(ip)))
    )
    out = new.withColumn("fault", own)
    for c, what in (("ip_address", "IP"), ("cidr", "CIDR")):
        held = listed.where(F.coalesce(c, F.lit("")) != "").select(F.col(c).alias("_v"), F.lit(None).cast("long").alias("_i"), F.lit(True).alias("_old"))
        first = out.where(own.isNull() & (F.coalesce(c, F.lit("")) != "")).select(F.col(c).alias("_v"), F.col("id").cast("long").alias("_i"), F.lit(False).alias("_old"))
        known = held.unionByName(first).groupBy("_v").agg(F.min("_i").alias("_i"), F.max("_old").alias("_old"))
        twice = F.col("_old") | (F.col("_i") < F.col("id"))
        out = out.join(known, F.col(c) == F.col("_v"), "left")
        out = out.withColumn("fault", F.coalesce("fault", F.when(twice, F.concat(F.lit(f"{what} "), c, F.lit(" already trusted"))))).drop("_v", "_i", "_old")
    return out


def added(listed: DataFrame, new: DataFrame) -> DataFrame:
    """``listed`` with those entries of ``new`` (same columns) that are not refused."""
    return listed.unionByName(refused(new, listed).where("fault IS NULL").select(*listed.columns))
