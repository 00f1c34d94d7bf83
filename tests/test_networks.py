"""Longest prefixes and clients against the standard library's addresses."""

import ipaddress
import random

import duckdb
from pyspark.sql import functions as F

from imgrel.operators import networks
from imgrel.plans import networks as plans


def slow_match(text, table):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    held = [n for n in table if ip in n]
    return str(max(held, key=lambda n: n.prefixlen)) if held else None


def test_longest_match(spark):
    rng = random.Random(4)
    four = [ipaddress.ip_network((rng.getrandbits(5) << 27 | rng.getrandbits(27), b), strict=False) for b in (0, 1, 3, 4, 7, 8, 15, 16, 22, 31, 32) for _ in range(3)]
    six = [ipaddress.ip_network((0x20010DB8 << 96 | rng.getrandbits(96), b), strict=False) for b in (0, 3, 32, 33, 35, 47, 64, 101, 127, 128) for _ in range(3)]
    table = [*four[3:], *six[3:]]
    texts = [str(n[rng.randrange(min(n.num_addresses, 1 << 40))]) for n in table for _ in range(4)]
    texts += [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(50)] + ["::ffff:10.0.0.1", "junk", "", None, "1.2.3", "01.2.3.4", "::1"]
    found = networks.longest_match(
        spark.createDataFrame([(t,) for t in texts * 2], "address string"), spark.createDataFrame([(str(n), 7) for n in table], "network string, tag int")
    ).collect()
    assert len(found) == len(set(texts))
    for r in found:
        assert r.network == (slow_match(r.address, table) if r.address else None), r.address
        assert r.tag == (7 if r.network else None)


def test_odd_networks(spark):
    odd = spark.createDataFrame([("10.0.0.0/33",), ("x/8",), ("10.0.0.0/",), (None,), ("fd00::/129",)], "network string")
    some = spark.createDataFrame([("10.0.0.1",), ("fd00::1",)], "address string")
    assert [r.network for r in networks.longest_match(some, odd).collect()] == [None, None]
    assert networks.longest_match(some.where("false"), odd).count() == 0
    judged = networks.denied(some, spark.createDataFrame([(" fd00:: / 8 ",)], "network string"))
    assert {r.address: r.denied for r in judged.collect()} == {"10.0.0.1": False, "fd00::1": True}


def test_clients(spark):
    trusted = spark.createDataFrame([("10.0.0.0/8",), ("fd00::/8",)], "network string")
    rows = [
        (1, "8.8.8.8", "1.1.1.1", None, "8.8.8.8"), (2, "10.0.0.1", "1.1.1.1, 2.2.2.2", None, "2.2.2.2"), (3, "10.0.0.1", "1.1.1.1,10.2.2.2,fd00::5", None, "1.1.1.1"),
        (4, "fd00::1", "junk, 10.0.0.9", "9.9.9.9", "9.9.9.9"), (5, "10.0.0.1", None, "10.0.0.2", "10.0.0.1"), (6, "10.0.0.1", "", None, "10.0.0.1"),
        (7, "fd00::1", "2001:DB8::1", "9.9.9.9", "2001:db8::1"), (8, None, "1.1.1.1", None, None), (9, "unix", "1.1.1.1", None, "unix"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "req_id long, peer string, xff string, real_ip string")
    assert {r.req_id: r.client for r in networks.clients(df, trusted).collect()} == {r[0]: r[4] for r in rows}
    assert networks.clients(df.where(F.lit(False)), trusted).count() == 0


def test_clients_of_many_users_match_their_sql(spark, sf_dir, tmp_path):
    """User ids of more than 16 bits, as the events have from 44 times the tables of sf0.1 on."""
    con = duckdb.connect()
    ids = "user_id + CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 65530 WHEN 2 THEN 1048576 ELSE 4294967290 END AS user_id"
    con.execute(f"COPY (SELECT * REPLACE ({ids}) FROM '{sf_dir}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    found = sorted((r.req_id, r.client) for r in plans.u7_networks(spark, str(tmp_path)).collect())
    assert found == sorted(con.sql(f"SELECT req_id, client FROM ({plans.U7})").fetchall())
    assert max(len(c.rsplit("::", 1)[-1]) for _, c in found if "::" in c and "." not in c) > 4


def test_addresses_keep_their_rows_and_are_not_shuffled(spark):
    table = spark.createDataFrame([("10.0.0.0/9",), ("fe80::/10",)], "network string")
    given = [("10.1.1.1", 1), ("10.1.1.1", 1), ("10.128.0.0", 2), (None, 3), ("FEBF::1", 4), ("fec0::1", 5), ("1:" * 9000 + "1", 6), ("fe80::1\n", 7)]
    judged = networks.denied(spark.createDataFrame(given, "address string, n int"), table)
    assert sorted((r.n, r.denied) for r in judged.collect()) == [(1, True), (1, True), (2, False), (3, False), (4, True), (5, False), (6, False), (7, False)]
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "rightHint=(strategy=broadcast)" in plan and "Generate explode(array_compact" not in plan


def test_many_networks_of_a_length_are_joined_by_shuffle(spark, monkeypatch):
    table = spark.createDataFrame([("10.0.0.0/8", "a"), ("10.0.0.0/10", "b"), ("10.64.0.0/12", "c"), ("10.0.0.0/10", "a")], "network string, tag string")
    some = spark.createDataFrame([("10.63.0.1",), ("10.64.0.1",), ("10.80.0.1",), ("11.0.0.1",)], "address string")
    for rows in (networks.BROADCAST_ROWS, 0):
        monkeypatch.setattr(networks, "BROADCAST_ROWS", rows)
        found = {r.address: (r.network, r.tag) for r in networks.longest_match(some, table).collect()}
        assert found == {"10.63.0.1": ("10.0.0.0/10", "a"), "10.64.0.1": ("10.64.0.0/12", "c"), "10.80.0.1": ("10.0.0.0/8", "a"), "11.0.0.1": (None, None)}


def test_equal_requests_stay_apart(spark):
    row = (1, "10.0.0.1", "1.1.1.1, 2.2.2.2", None)
    df = spark.createDataFrame([row, row, (1, "10.0.0.1", "3.3.3.3", None)], "req_id long, peer string, xff string, real_ip string")
    found = networks.clients(df, spark.createDataFrame([("10.0.0.0/8",)], "network string")).collect()
    assert sorted(r.client for r in found) == ["2.2.2.2", "2.2.2.2", "3.3.3.3"]
