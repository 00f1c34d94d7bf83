"""Addresses against tables of networks, by prefix: an equi-join at each number of whole digits in use, not a range join.

An address of either family is a string of hexadecimal digits after the number
of its family, so a network is a prefix of it.  A network that ends within a
digit stands as the two to eight prefixes of whole digits that make it up, so
there are at most 33 lengths, however many networks, and every address keeps
its own row: where the networks of a length are few enough to be broadcast,
addresses are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ipv6, urls

#: The most prefixes of one length that are sent to every task.
BROADCAST_ROWS = 100_000


def address_key(text: Column) -> Column:
    """``4`` and 8 digits, or ``6`` and 32 digits; null if the text is no address."""
    return F.coalesce(F.concat(F.lit("4"), F.lower(F.lpad(F.hex(urls.address(text)), 8, "0"))), F.concat(F.lit("6"), ipv6.digits(text)))


def prefix(key: Column, bits: Column | int) -> Column:
    """The first ``bits`` bits of a key, after its family."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    whole = F.floor(bits / 4).cast("int")
    mask = F.element_at(F.array(*map(F.lit, (0, 8, 12, 14))), (bits % 4 + 1).cast("int"))
    digit = F.conv(F.substr(key, whole + 2, F.lit(1)), 16, 10).cast("int").bitwiseAND(mask)
    return F.concat(F.substr(key, F.lit(1), whole + 1), F.when(bits % 4 == 0, "").otherwise(F.lower(F.hex(digit))))


def parsed(networks: DataFrame, column: str = "network") -> DataFrame:
    """``networks`` with ``bits`` and ``prefix``, an address alone as a network of its own; null for what is no network."""
    parts = F.split(F.col(column), "/", 2)
    key, given = address_key(F.trim(F.get(parts, 0))), F.trim(F.get(parts, 1))
    most = F.when(F.startswith(key, F.lit("4")), 32).otherwise(128)
    bits = F.when(F.size(parts) == 1, most).otherwise(F.when(given.rlike("^[0-9]{1,3}$"), given.try_cast("int")))
    keyed = networks.withColumn("key_", key).withColumn("bits", F.when(F.col("key_").isNotNull() & (bits <= most), bits))
    return keyed.withColumn("prefix", prefix(F.col("key_"), F.col("bits"))).drop("key_")


def whole_digits(networks: DataFrame) -> DataFrame:
    """``(at, found)`` of ``networks``: prefixes of whole digits, each once, with the longest network that holds all of it.

    ``found`` has ``network`` and the other columns; of equal networks the one
    whose others come first.
    """
    others = [c for c in networks.columns if c != "network"]
    known = parsed(networks).where("bits IS NOT NULL").groupBy("prefix", "bits").agg(F.min(F.struct("network", *others)).alias("found"))
    last, free = F.conv(F.right("prefix", F.lit(1)), 16, 10).cast("int"), F.element_at(F.array(*map(F.lit, (0, 7, 3, 1))), F.col("bits") % 4 + 1)
    ends = F.transform(F.sequence(F.lit(0), free), lambda k: F.concat(F.expr("left(prefix, length(prefix) - 1)"), F.lower(F.hex(last + k))))
    at = F.explode(F.when(F.col("bits") % 4 == 0, F.array("prefix")).otherwise(ends))
    return known.select(at.alias("at"), "bits", "found").groupBy("at").agg(F.max_by("found", "bits").alias("found"))


def looked_up(addresses: DataFrame, networks: DataFrame, column: str = "address") -> DataFrame:
    """All rows of ``addresses`` with ``found``, the longest of ``networks`` that holds the address; null where none does.

    A row may bring its ``key_``.  No address of one family lies in a network
    of the other.
    """
    known = whole_digits(networks)
    # at most 33 rows
    sizes = known.groupBy(F.length("at").alias("digits")).count().orderBy(F.desc("digits")).collect()
    rows = addresses if "key_" in addresses.columns else addresses.withColumn("key_", address_key(F.col(column)))
    for digits, count in sizes:
        some = known.where(F.length("at") == digits).select(F.col("at").alias(f"at_{digits}"), F.col("found").alias(f"found_{digits}"))
        some = F.broadcast(some) if count <= BROADCAST_ROWS else some
        rows = rows.join(some, F.substring("key_", 1, digits) == F.col(f"at_{digits}"), "left")
    names = [f"{x}_{r.digits}" for r in sizes for x in ("at", "found")]
    nothing = F.lit(None).cast(known.schema["found"].dataType)
    return rows.withColumn("found", F.coalesce(*(F.col(f"found_{r.digits}") for r in sizes), nothing)).drop("key_", *names)


def longest_match(addresses: DataFrame, networks: DataFrame, column: str = "address") -> DataFrame:
    """The distinct ``addresses`` with the columns of the longest of ``networks`` that holds them; null where none does.

    ``networks`` has ``network`` (``10.0.0.0/8``, ``fd00::/8`` or an address)
    and others; of equal networks the one whose others come first counts.
    """
    others = [c for c in networks.columns if c != "network"]
    found = looked_up(addresses.select(column).distinct(), networks, column)
    return found.select(column, *(F.col(f"found.{c}").alias(c) for c in ("network", *others)))


def clients(requests: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(req_id, client)`` of ``requests`` (req_id, peer, xff, real_ip), with ``trusted`` networks.

    A peer that is not trusted is the client, whatever the headers say.  Else
    it is the rightmost forwarded address that is not trusted, else the
    real-ip header if that is not, else the peer.
    """
    last = (1 << 31) - 1
    hops = F.reverse(F.split(F.col("xff"), ","))
    ranked = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.col("peer").alias("text"))),
        F.coalesce(F.transform(hops, lambda x, i: F.struct((i + 1).alias("rank"), F.trim(x).alias("text"))), F.array()),
        F.array(F.struct(F.lit(last).alias("rank"), F.trim("real_ip").alias("text"))),
    )
    given = ["req_id", "peer", "xff", "real_ip"]
    candidates = requests.select(*given, F.explode(ranked).alias("c")).select(*given, "c.rank", address_key(F.lower("c.text")).alias("key_"))
    judged = looked_up(candidates.where(F.col("key_").isNotNull() | (F.col("rank") == 0)), trusted)
    usable, proxied = (F.col("rank") > 0) & F.col("found").isNull(), (F.col("rank") == 0) & F.col("found").isNotNull()
    # only numbers are added up; requests that are alike in all columns stay as many as they were
    judged = judged.groupBy(*given).agg(
        F.bool_or(proxied).alias("proxied"), F.min(F.when(usable, F.col("rank"))).alias("best"), F.count_if(F.col("rank") == 0).cast("int").alias("times"),
    )
    forwarded = F.when(F.col("best") == last, F.col("real_ip")).otherwise(F.get(hops, F.col("best") - 1))
    client = F.when(F.col("proxied"), F.coalesce(F.lower(F.trim(forwarded)), "peer")).otherwise(F.col("peer"))
    return judged.select("req_id", client.alias("client"), F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("time")).drop("time")


def denied(addresses: DataFrame, networks: DataFrame, column: str = "address") -> DataFrame:
    """``addresses`` with ``denied``: whether a network holds the address."""
    return looked_up(addresses, networks, column).withColumn("denied", F.col("found").isNotNull()).drop("found")
