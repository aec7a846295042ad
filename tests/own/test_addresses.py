import ipaddress
import random
import re

from pyspark.sql import functions as F

from quire.functions import addresses as A


def slow(host):
    """What the library of the language says."""
    if not host:
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return False if re.fullmatch(r"0[xX][0-9a-fA-F]*|[0-9]+", host.rstrip(".").rsplit(".", 1)[-1]) else None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not (ip.is_multicast or ip.is_reserved or getattr(ip, "is_site_local", False))


def told(spark, hosts):
    frame = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "k int, h string")
    found = frame.select("k", A.public_host(F.col("h")).alias("p"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    return [r.p for r in found.orderBy("k").collect()]


# Hosts that must be refused, private ones and old spellings, and names.
PRIVATE = "127.0.0.1 10.1.2.3 172.16.0.1 192.168.1.1 169.254.169.254 100.64.0.1 0.0.0.0 ::1 ::ffff:127.0.0.1 fe80::1 fc00::1 2130706433 fec0::1".split()
LEGACY = "0177.0.0.1 012.0.0.1 0144.0100.0.1 127.1 2130706433 0x7f.0.0.1 0x7f000001 017700000001 0177.0.0.1.".split()


def test_hosts_that_are_refused_and_names(spark):
    assert told(spark, [*PRIVATE, *LEGACY, "", None]) == [False] * (len(PRIVATE) + len(LEGACY) + 2)
    assert told(spark, ["localhost", "1.example.com", "0177.example", "93.184.216.34", "2606:4700::1111", "fe80::1%eth0"]) == [None, None, None, True, True, False]


def test_every_border_of_every_range(spark):
    hosts = []
    for network in [*A.CLOSED, *A.OPEN]:
        n = ipaddress.ip_network(network)
        for at in (int(n.network_address), int(n.broadcast_address)):
            for near in (at - 1, at, at + 1):
                if 0 <= near < 1 << n.max_prefixlen:
                    hosts.append(str(type(n.network_address)(near)))
    assert told(spark, hosts) == [slow(h) for h in hosts]


def test_random_addresses_and_texts(spark):
    rng = random.Random(5)
    hosts = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    for _ in range(600):
        ip = ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), rng.getrandbits(64), (0x2000 << 112) | rng.getrandbits(120), 0xFFFF << 32 | rng.getrandbits(32), rng.getrandbits(128) & ~(0xFFFFFFFF << 48)]))
        hosts.append(rng.choice([str(ip), ip.exploded, str(ip).upper()]))
    for _ in range(2000):
        hosts.append("".join(rng.choice(["1", "0", "ff", "a", ":", ":", "::", ".", "127.0.0.1", "256", "%x", "g", "12345"]) for _ in range(rng.randrange(1, 12))))
    got, want = told(spark, hosts), [slow(h) for h in hosts]
    assert [(h, g, w) for h, g, w in zip(hosts, got, want, strict=True) if g != w] == []
