"""Country by nested and overlapping ranges of both families, against a scan of all ranges."""

import ipaddress
import random


from clickwise.functions import ip_key
from clickwise.operators.georanges import disjoint, range_country, range_pieces


def key(text):
    a = ipaddress.ip_address(text)
    return f"{(0xFFFF << 32) + int(a) if a.version == 4 else int(a):032x}"


def test_address_keys(spark):
    good = ["1.2.3.4", "255.255.255.255", "::", "::1", "1::", "2001:DB8::8:800:200c:417A", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7::"]
    bad = ["", "x", "1.2.3", "1.2.3.256", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::12345", "::g", "1:2:3:4:5:6:7:8::", "::1.2.3.256", ":1", None]
    rows = [*enumerate(good + ["fe80::1%eth0"] + bad)]
    got = [r.k for r in spark.createDataFrame(rows, "i int, ip string").select("i", ip_key("ip").alias("k")).orderBy("i").collect()]
    assert got == [key(g) for g in good] + [key("fe80::1")] + [None] * len(bad)


def test_segments_equal_a_scan():
    rnd = random.Random(1)
    for _ in range(200):
        ranges = [(a, a + w, w, rnd.choice("abc")) for a, w in ((rnd.randrange(60), rnd.choice([0, 1, 3, 9, 40])) for _ in range(rnd.randrange(9)))]
        held = list(disjoint(ranges))
        assert all(a[1] < b[0] for a, b in zip(held, held[1:])) and all(a <= b for a, b, _ in held)
        for x in range(110):
            want = min(((w, c) for a, b, w, c in ranges if a <= x <= b), default=(0, None))[1]
            assert [c for a, b, c in held if a <= x <= b] == ([want] if want else [])


def test_every_click_meets_the_narrowest_range_once(spark):
    rnd = random.Random(2)

    def text(family, n):
        return str(ipaddress.IPv4Address(n) if family == 4 else ipaddress.IPv6Address(n))

    ranges = [("0.0.0.0", "255.255.255.255", "all4"), ("10.0.0.0", "10.255.255.255", "ten"), ("10.0.0.0", "10.255.255.255", "same"),
              ("2000::", "3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "all6"), ("9.9.9.9", "1.1.1.1", "turned"), ("1.1.1.1", "::9", "mixed"),
              ("no", "1.2.3.4", "unread"), ("2001:db8::", "2001:db8::", "one"), ("2001:db8::", "2001:db8::", "one")]
    for i in range(150):
        family, bits = rnd.choice([(4, 32), (6, 128)])
        n = rnd.randrange(1 << 32) if family == 4 else (0x20010000 + rnd.randrange(1 << 18) << 96) + rnd.randrange(1 << 96)
        width = 1 << rnd.randrange(bits - 6)
        ranges.append((text(family, n), text(family, min(n + width - 1, (1 << bits) - 1)), f"c{i % 40}"))
    ips = ["no address", "", None, "2001:db8::", "::1", "::ffff:10.1.2.3"]
    for a, b, _ in ranges[9:]:
        low, high = ipaddress.ip_address(a), ipaddress.ip_address(b)
        family = low.version
        top = (1 << (32 if family == 4 else 128)) - 1
        ips += [text(family, min(max(int(x) + d, 0), top)) for x in (low, high) for d in (-1, 0, 1)]
        ips += [text(family, rnd.randint(int(low), int(high)))]
    fair = []
    for a, b, c in ranges:
        try:
            if ipaddress.ip_address(a).version == ipaddress.ip_address(b).version:
                fair.append((int(key(a), 16), int(key(b), 16), c))
        except ValueError:
            pass

    def scan(ip):
        try:
            n = int(key(ip), 16)
        except ValueError:
            return None
        return min(((b - a, c) for a, b, c in fair if a <= n <= b), default=(0, None))[1]

    table = spark.createDataFrame(ranges, "ip_from string, ip_to string, country string")
    df = spark.createDataFrame([*enumerate(ips)], "i int, raw_ip string")
    got = df.transform(range_country(table)).collect()
    assert sorted(r.i for r in got) == list(range(len(ips)))
    assert {r.i: r.country for r in got} == {i: scan(ip) for i, ip in enumerate(ips)}
    pieces = range_pieces(table).orderBy("key_from").collect()
    assert all(a.key_to < b.key_from for a, b in zip(pieces, pieces[1:]))


def test_empty_tables_and_numbers(spark):
    numbers = spark.createDataFrame([(0, 255, "low"), (16, 31, "in")], "ip_from long, ip_to long, country string")
    df = spark.createDataFrame([("0.0.0.20",), ("0.0.0.200",), ("0.0.1.0",)], "raw_ip string")
    got = {r.raw_ip: (r.ip_num, r.country) for r in df.transform(range_country(numbers)).collect()}
    assert got == {"0.0.0.20": (20, "in"), "0.0.0.200": (200, "low"), "0.0.1.0": (256, None)}
    assert [r.country for r in df.transform(range_country(numbers.limit(0))).collect()] == [None] * 3
    assert df.limit(0).transform(range_country(numbers)).count() == 0
