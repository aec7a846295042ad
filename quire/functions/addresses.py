"""Internet addresses as Column functions: both forms to 32 hexadecimal digits, and whether they are public.

An address of version 4 is the mapped one of version 6, so one order holds all. The ranges that are not
public are merged into one sorted list of borders; a binary search in it, a tree of comparisons that
names the address once, tells on which side an address lies.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import bound

# Networks that are private, shared, reserved, local to a link or site, for examples, or multicast.
CLOSED = """
    0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24
    203.0.113.0/24 224.0.0.0/4 240.0.0.0/4
    ::/8 100::/8 200::/7 400::/6 800::/5 1000::/4 2001::/23 2001:db8::/32 2002::/16
    4000::/3 6000::/3 8000::/3 a000::/3 c000::/3 e000::/4 f000::/5 f800::/6 fe00::/9 fc00::/7 fe80::/10 fec0::/10 ff00::/8
""".split()
#: Networks within those that are public all the same.
OPEN = "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
MAPPED = 0xFFFF << 32


def spans(network: str) -> list[tuple[int, int]]:
    """First address of a network and the one after its last, as numbers of version 6; where it holds the mapped addresses, what is beside them."""
    n = ipaddress.ip_network(network)
    base = MAPPED if n.version == 4 else 0
    first, after = base + int(n.network_address), base + int(n.broadcast_address) + 1
    return [(first, MAPPED), (MAPPED + (1 << 32), after)] if n.version == 6 and first <= MAPPED < after else [(first, after)]


def borders(closed: list[str], open_: list[str]) -> list[int]:
    """Places, in order, at which addresses stop being public, or being closed; the first such place is a stop."""
    ends: dict[int, int] = {}
    for networks, weight in ((closed, 1), (open_, -len(closed))):
        for first, after in (s for n in networks for s in spans(n)):
            ends[first] = ends.get(first, 0) + weight
            ends[after] = ends.get(after, 0) - weight
    out, depth = [], 0
    for at in sorted(ends):
        was, depth = depth > 0, depth + ends[at]
        if was != (depth > 0):
            out.append(at)
    return out


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
QUAD = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"


def quad_digits(text: Column, pattern: str) -> Column:
    """Eight digits of the four numbers that a pattern finds in a text."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.regexp_extract(text, pattern, k).cast("int")), 2, "0") for k in range(1, 5)]))


def hexadecimal(host: Column) -> Column:
    """The 32 digits of an address of either form; null for what is none, old spellings of version 4 included."""

    def of_groups(p: Column) -> Column:
        n = F.size(p.left) + F.size(p.right)
        whole = F.when(p.sides == 1, n == 8).otherwise((p.sides == 2) & (n <= 7)) & F.forall(F.concat(p.left, p.right), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        text = lambda side: F.array_join(F.transform(side, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(whole, F.concat(text(p.left), F.repeat(F.lit("0000"), 8 - n), text(p.right)))

    def of_sides(sides: Column) -> Column:
        groups = lambda k: F.when(F.coalesce(F.get(sides, F.lit(k)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(sides, F.lit(k)), ":"))
        return bound(F.struct(groups(0).alias("left"), groups(1).alias("right"), F.size(sides).alias("sides")), of_groups)

    def six(h: Column) -> Column:
        """Version 6, whose last two groups may be written as version 4."""
        tail = bound(quad_digits(h, rf":{QUAD}$"), lambda d: F.concat(F.regexp_replace(h, rf":{QUAD}$", ":"), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))
        return bound(F.split(F.when(h.rlike(rf":{QUAD}$"), tail).otherwise(h), "::"), of_sides)

    def either(h: Column) -> Column:
        return F.when(h.rlike(rf"^{QUAD}$"), F.concat(F.lit("00000000000000000000ffff"), quad_digits(h, rf"^{QUAD}$"))).when(h.contains(":"), six(h))

    # The zone of an address of version 6 goes.
    return bound(F.lower(F.regexp_replace(host, r"(?<=:.{0,99})%[^%]+$", "")), either)


def public(digits: Column) -> Column:
    """Whether the address of these 32 digits is public."""
    places = [f"{b:032x}" for b in borders(CLOSED, OPEN) if b < 1 << 128]

    def search(d: Column, low: int, high: int) -> Column:
        """places[low:high] may stand at or before the address; an even number before it says public."""
        if low == high:
            return F.lit(low % 2 == 0)
        middle = (low + high) // 2
        return F.when(d < places[middle], search(d, low, middle)).otherwise(search(d, middle + 1, high))

    return bound(digits, lambda d: F.when(d.isNotNull(), search(d, 0, len(places))))


def public_host(host: Column) -> Column:
    """Whether an address literal is public; False for no host and for numbers in old spellings; null for names, which only a resolver can tell."""
    last = F.regexp_extract(F.regexp_replace(host, r"\.+$", ""), r"([^.]*)$", 1)
    old = last.rlike("^(0[xX][0-9a-fA-F]*|[0-9]+)$")
    return F.coalesce(public(hexadecimal(host)), F.when(host.isNull() | (host == "") | old, False))
