"""Addresses are looked up among intervals as Python's own networks have it, few or many."""

import ipaddress
import random

from logsieve.operators import networks

SCHEMA = "id long, ip_address string, cidr string"


def expected(nets, ip):
    try:
        return any(ipaddress.ip_address(ip) in n for n in nets)
    except ValueError:
        return False


def test_look_up(spark, monkeypatch):
    rng = random.Random(3)
    near = lambda: f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}"
    for case in range(4):
        cidrs = [f"{near()}/{rng.choice([15, 16, 17, 23, 24, 28, 30, 31, 32] if case else [32])}" for _ in range(case * 30)] + ["172.16.0.0/12"] * (case == 2) + ["0.0.0.0/1", "128.0.0.0/32"] * (case == 3)
        alone = [near() for _ in range(case * 5)]
        nets = [ipaddress.ip_network(c, strict=False) for c in cidrs + alone]
        listed = spark.createDataFrame([(0, "", c) for c in cidrs] + [(0, a, None) for a in alone] + [(0, "10.0.0", ""), (0, "", "10.0.0.0/33"), (0, "1.2.3.4", "bad"), (0, None, None), (0, "::1", "")], SCHEMA)
        ips = [near() for _ in range(300)] + ["172.31.255.255", "172.32.0.0", "127.255.255.255", "128.0.0.0", "128.0.0.1", "", None, "10.0.0.256", "::1"]
        events = spark.createDataFrame([(i, ip, "x") for i, ip in enumerate(ips)], "i long, ip string, block string")
        want = {i: expected(nets, ip) for i, ip in enumerate(ips)}
        for limit in (100_000, -1):
            monkeypatch.setattr(networks, "BROADCAST_ROWS", limit)
            got = networks.with_trust(events, listed, "ip")
            assert got.columns == ["i", "ip", "block", "trusted"]
            assert {r.i: r.trusted for r in got.collect()} == want


def test_blocks_hold_disjoint_intervals(spark):
    listed = spark.createDataFrame([(0, "", c) for c in ("10.0.0.0/25", "10.0.0.128/25", "10.0.0.7/32", "10.0.2.0/24", "10.2.0.0/15", "10.0.255.255/32")], SCHEMA)
    got = {r.block: (r.firsts, r.lasts) for r in networks.blocks(listed).collect()}
    assert got == {2560: ([0, 512, 65535], [255, 767, 65535]), 2562: ([0], [65535]), 2563: ([0], [65535])}


def test_entries_that_are_refused(spark):
    listed = spark.createDataFrame([(1, "10.0.0.1", ""), (2, None, "10.1.0.0/16")], SCHEMA)
    new = [(3, "", None), (4, "10.0.0.1", ""), (5, "", "10.1.0.0/16"), (6, "10.0.0.2", "nothing"), (7, "10.0.0.300", ""), (8, "10.0.0.2", ""), (9, "10.0.0.2", "10.2.0.0/16"), (10, "10.0.0.3", "10.2.0.0/16")]
    new = spark.createDataFrame(new, SCHEMA)
    got = {r.id: r.fault for r in networks.refused(new, listed).collect()}
    assert got == {
        3: "either ip_address or cidr must be provided", 4: "IP 10.0.0.1 already trusted", 5: "CIDR 10.1.0.0/16 already trusted", 6: 'invalid CIDR "nothing"',
        7: 'invalid IP address "10.0.0.300"', 8: None, 9: "IP 10.0.0.2 already trusted", 10: "CIDR 10.2.0.0/16 already trusted",
    }
    assert {r.id for r in networks.added(listed, new).collect()} == {1, 2, 8}
