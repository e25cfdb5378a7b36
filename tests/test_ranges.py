"""Large files read by ranges give what one pass over them gives."""

import json
import random
import struct

from tests.test_sources import frame, udp

from fenwatch.sources import captures as K
from fenwatch.sources import logs as L


def head(order="<"):
    return struct.pack(f"{order}IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)


def record(data, second, order="<"):
    return struct.pack(f"{order}IIII", second, 5, len(data), len(data)) + data


def rows(df):
    return sorted(map(str, df.collect()))


def test_captures_by_ranges(spark, tmp_path):
    rng = random.Random(3)
    # payloads that look like packets of the capture, beyond any range, and plain ones
    inner = b"".join(record(bytes(40), 1_700_000_000) for _ in range(12))
    payloads = [rng.choice([inner, bytes(rng.randrange(900)), rng.randbytes(rng.randrange(60)), inner * 3]) for _ in range(200)]
    frames = [udp("10.0.0.1", "10.0.0.2", 502, 40_000 + k, p[:1400]) for k, p in enumerate(payloads)]
    for name, order in (("a.pcap", "<"), ("b.pcap", ">")):
        (tmp_path / name).write_bytes(head(order) + b"".join(record(f, 1_700_000_000 + k, order) for k, f in enumerate(frames)))
    (tmp_path / "early.pcap").write_bytes((head() + b"".join(record(f, 1_700_000_000 + k) for k, f in enumerate(frames)))[:-7])
    (tmp_path / "half.pcap").write_bytes(head() + record(frames[0], 1) + bytes(9))
    (tmp_path / "bare.pcap").write_bytes(head())
    (tmp_path / "no.pcap").write_bytes(b"nothing of the kind" * 100)
    (tmp_path / "empty.pcap").write_bytes(b"")
    spark.dataSource.register(K.Captures)
    whole = rows(spark.read.format("pcap").load(f"file:{tmp_path}"))
    assert sum("warning='" in r for r in whole) == 3
    for size in (2_000, 1 << 20):
        found = K.read_captures(spark, str(tmp_path), size=size)
        assert rows(found) == whole
        assert found.rdd.getNumPartitions() > (20 if size < 8_000 else 0)
        assert rows(K.read_captures(spark, str(tmp_path), most=50, size=size)) == rows(spark.read.format("pcap").option("most", 50).load(f"file:{tmp_path}"))


def test_options_rule_ranges_out(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(head() + b"".join(record(frame("10.0.0.1", "10.0.0.2", 502, 9, b"x" * 100), 1_700_000_000 + k) for k in range(400)))
    (tmp_path / "b.pcap").write_bytes(head() + record(frame("10.0.0.1", "10.0.0.2", 502, 9, b"x"), 1_600_000_000) + b"end")
    index = K.index_captures(spark, str(tmp_path), 2_000)
    spark.dataSource.register(K.Captures)
    read = lambda **o: spark.read.format("pcap").options(index=index, range=2_000, **o).load(str(tmp_path))
    found, late = read(), read(since=1_700_000_390)
    assert (late.count(), found.count(), read(until=1_700_000_005).count()) == (10, 402, 6)
    assert late.rdd.getNumPartitions() < 5 < 20 < found.rdd.getNumPartitions()
    one = found.where("warning IS NOT NULL").first()["file"]
    assert read(file=one).rdd.getNumPartitions() == 1 and read(file=one).count() == 2
    narrow = spark.read.format("pcap").schema("src string, packet long").option("index", index).load(str(tmp_path))
    assert narrow.columns == ["src", "packet"] and narrow.count() == 402 and narrow.where("src = '10.0.0.1'").count() == 401


def test_logs_by_ranges(spark, tmp_path):
    part = lambda sep, path, names, n: f"#separator {sep}\n" + (f"#path{chr(int(sep[2:], 16))}{path}\n" if path else "") + chr(int(sep[2:], 16)).join(["#fields", *names]) + "\n" + "".join(chr(int(sep[2:], 16)).join(f"{k}é" for _ in names) + "\r\n" for k in range(n)) + "#close\n"
    text = part("\\x09", "conn", ["ts", "a"], 200) + part("\\x7c", "", ["b", "c", "d"], 150) + "\n\n" + part("\\x09", "dns", ["q"], 100) + '{"x": {"y": 1}}\n{broken\n' + "#fields\tz\tz2\n" + "1\t2\n" * 90 + "last\tline"
    (tmp_path / "many.log").write_text(text, newline="")
    (tmp_path / "none.log").write_text("x\ty\n" * 300 + "#fields\ta\n" + "late\n" * 300)
    (tmp_path / "json.log").write_text("".join(json.dumps({"ts": k, "v": "w" * (k % 70)}) + "\n" for k in range(300)))
    (tmp_path / "empty.log").write_text("")
    spark.dataSource.register(L.Logs)
    whole = rows(spark.read.format("zeek").load(f"file:{tmp_path}"))
    assert len(whole) == 200 + 150 + 100 + 2 + 91 + 1 + 300
    for size in (60, 1_000, 1 << 20):
        found = L.read_zeek(spark, str(tmp_path), size)
        assert rows(found.drop("ts")) == whole
    found, dns = L.read_zeek(spark, str(tmp_path), 500), L.read_zeek(spark, str(tmp_path), 500, kind="dns")
    assert dns.count() == 100 + 2 + 91 and dns.rdd.getNumPartitions() < found.rdd.getNumPartitions() / 2
