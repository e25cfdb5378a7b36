"""Rows S2-S18, S24, P1-P9, F8-F12, A5-A6: readers and decoders on small inputs made here."""

import gzip
import json
import struct

import pytest

from fenwatch.sources import captures as K
from fenwatch.sources import decoders as D
from fenwatch.sources import feeds as F
from fenwatch.sources import logs as L


def modbus_reply():
    objects = b"".join(bytes([k, len(v)]) + v for k, v in enumerate([b"Acme", b"AC-100", b"V2.1"]))
    pdu = bytes([43, 14, 1, 1, 0, 0, 3]) + objects
    return struct.pack(">HHHB", 7, 0, len(pdu) + 1, 1) + pdu


def enip_reply(name=b"1234-ABC/Z Module"):
    item = struct.pack("<HhHIQ", 1, 0, 0, 0, 0) + struct.pack("<HHHBBH", 1, 12, 58, 4, 6, 0) + struct.pack("<I", 0x00AB12CD) + bytes([len(name)]) + name + b"\x03"
    body = struct.pack("<HHH", 1, 0x0C, len(item)) + item
    return struct.pack("<HHII", 0x63, len(body), 0, 0) + b"\0" * 12 + body


def s7_reply(error=0xFF):
    records = struct.pack(">H", 1) + b"6ES7 999-0AA00-0XX0 " + b"\0" * 3 + bytes([2, 0, 7]) + struct.pack(">H", 7) + b" " * 20 + b"\0\0\0" + bytes([3, 2, 6])
    data = bytes([error, 9]) + struct.pack(">H", 8 + len(records)) + struct.pack(">HHHH", 0x11, 0, 28, 2) + records
    param = bytes([0, 1, 18, 8, 0x12, 0x84, 1, 1, 0, 0, 0, 0])
    pdu = struct.pack(">BBHHHH", 0x32, 7, 0, 1, len(param), len(data)) + param + data
    frame = b"\x02\xf0\x80" + pdu
    return struct.pack(">BBH", 3, 0, len(frame) + 4) + frame


def bacnet_reply():
    apdu = bytes([0x30, 1, 12]) + b"\x0c\x02\0\0\x01" + bytes([0x19, 70, 0x3E]) + bytes([0x75, 7, 0]) + b"MX-200" + b"\x3f"
    frame = b"\x01\x00" + apdu
    return struct.pack(">BBH", 0x81, 0x0A, len(frame) + 4) + frame


@pytest.mark.parametrize(
    "raw,port,verdict,protocol,field,value",
    [
        (modbus_reply(), 502, "decoded", "modbus", "product_code", "AC-100"),
        (struct.pack(">HHHBBB", 7, 0, 3, 1, 0xAB, 1), 502, "device-error", "modbus", "exception_code", "1"),
        (enip_reply(), 44818, "decoded", "enip", "revision", "4.6"),
        (s7_reply(), 102, "decoded", "s7comm", "module_order_number", "6ES7 999-0AA00-0XX0"),
        (s7_reply(), 102, "decoded", "s7comm", "module_firmware_version", "V2.0.7"),
        (s7_reply(0x0A), 102, "device-error", "s7comm", None, None),
        (bacnet_reply(), 47808, "decoded", "bacnet", "model_name", "MX-200"),
        (modbus_reply(), 5020, "decoded", "modbus", "vendor_name", "Acme"),
        (modbus_reply()[:12], 502, "truncated", None, None, None),
        (b"HTTP/1.1 200 OK\r\n\r\n", 502, "not-this-protocol", None, None, None),
        (b"", None, "not-this-protocol", None, None, None),
    ],
)
def test_decoders(raw, port, verdict, protocol, field, value):
    got, seen = D.decode(raw, port)
    assert got == verdict and (seen.protocol if seen else None) == protocol
    if field:
        assert seen.fields[field] == value


def test_identities_and_roles():
    seen = D.decode(enip_reply(), 44818)[1]
    assert seen.identity == {"firmware_raw": "4.6", "firmware": "4.6", "serial": "00AB12CD", "product_raw": "1234-ABC/Z Module", "product": "1234-ABC/Z Module", "vendor_raw": "Rockwell Automation/Allen-Bradley", "vendor": "Rockwell Automation/Allen-Bradley", "catalog_number": "1234-ABC"}
    assert seen.fields["device_type_name"] == "Communications Adapter" and seen.role == ""
    seen = D.decode(s7_reply(), 102)[1]
    assert seen.identity == {"catalog_number": "6ES7 999-0AA00-0XX0", "firmware": "V2.0.7", "firmware_raw": "V2.0.7", "vendor_raw": "Siemens", "vendor": "Siemens"} and seen.role == "plc"
    seen = D.decode(bacnet_reply(), 47808)[1]
    assert seen.identity == {"product_raw": "MX-200", "product": "MX-200"} and seen.role == "building-controller"
    seen = D.decode(modbus_reply(), 502)[1]
    assert seen.identity["catalog_number"] == "AC-100" and "product_raw" not in seen.identity and seen.role == ""


def test_shapes_that_are_not_answers():
    """Frames of other services, records that end early, and answers without identity."""
    assert D.decode(b"\0" * 24, 5450)[0] == "not-this-protocol"
    short = s7_reply()
    cut = bytearray(short[: len(short) - 28])
    cut[2:4] = struct.pack(">H", len(cut))
    at = short.index(b"\x32") + 8
    cut[at : at + 2] = struct.pack(">H", int.from_bytes(short[at : at + 2], "big") - 28)
    verdict, seen = D.decode(bytes(cut), 102)
    assert verdict == "decoded" and seen.fields["module_order_number"] and any("ends after 1 of 2" in n for n in seen.notes)
    confirm = struct.pack(">BBH", 3, 0, 11) + bytes([6, 0xD0, 0, 0, 0, 1, 0])
    assert D.decode(confirm, 102)[1].fields == {"cotp_response": "connection confirm"} and D.decode(confirm, 102)[1].role == ""
    other = struct.pack(">HHHBBB", 1, 0, 5, 1, 3, 2) + b"\0\x07"
    assert D.decode(other, 502)[1].fields == {"transaction_id": "1", "unit_id": "1", "function_code": "3"}
    reject = b"\x01\x00" + bytes([0x60, 5, 9])
    assert D.decode(struct.pack(">BBH", 0x81, 0x0A, len(reject) + 4) + reject, 47808)[1].error == (9, "request rejected with reason 9")


def test_replay(spark, tmp_path):
    from fenwatch.sources import fixtures as X

    frames = {"modbus": (modbus_reply(), 502), "s7": (s7_reply(), 102), "bacnet": (bacnet_reply(), 47808), "enip": (enip_reply(), 44818), "web": (b"HTTP/1.1 200 OK", 502), "early": (modbus_reply()[:9], 502)}
    for name, (raw, port) in frames.items():
        verdict, seen = D.decode(raw, port)
        expect = {"verdict": verdict} | ({"protocol": seen.protocol, "fields": seen.fields, "identity": seen.identity, "role": seen.role} if seen else {})
        (tmp_path / f"{name}.json").write_text(json.dumps({"id": name, "summary": "s", "port": port, "transport": "tcp", "response": raw.hex(" "), "expect": expect}))
    assert {r["id"]: r["agrees"] for r in X.replay(X.read_fixtures(spark, str(tmp_path))).collect()} == dict.fromkeys(frames, True)
    (tmp_path / "odd.json").write_text(json.dumps({"id": "other", "port": 1}))
    with pytest.raises(ValueError):
        X.read_fixtures(spark, str(tmp_path))


def test_every_prefix_is_survived():
    for raw in (modbus_reply(), enip_reply(), s7_reply(), bacnet_reply()):
        for k in range(len(raw)):
            for port in (None, 502, 102, 44818, 47808):
                assert D.decode(raw[:k], port)[0] in ("decoded", "truncated", "not-this-protocol", "device-error")


def frame(src, dst, sport, dport, payload, flags=0x18):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 1, 1, 0x50, flags, 1024, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 1, 0, 64, 6, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return b"\x02" * 6 + b"\x04" * 6 + b"\x08\x00" + ip + tcp


def test_captures(spark, tmp_path):
    reply = modbus_reply()
    frames = [frame("10.0.0.9", "10.0.0.1", 50000, 502, b"", 2), frame("10.0.0.1", "10.0.0.9", 502, 50000, reply[:11]), frame("10.0.0.1", "10.0.0.9", 502, 50000, reply[11:])]
    body = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for k, f in enumerate(frames):
        body += struct.pack("<IIII", 1_700_000_000, k * 10_000, len(f), len(f)) + f
    (tmp_path / "a.pcap").write_bytes(body)
    (tmp_path / "b.pcap.gz").write_bytes(gzip.compress(body + b"\0" * 7))
    block = lambda kind, data: struct.pack("<II", kind, len(data) + 12) + data + struct.pack("<I", len(data) + 12)
    ng = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for k, f in enumerate(frames):
        stamp = 1_700_000_000_000_000 + k
        ng += block(6, struct.pack("<IIIII", 0, stamp >> 32, stamp & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    (tmp_path / "c.pcapng").write_bytes(ng)
    found = K.read_captures(spark, str(tmp_path))
    assert found.where("warning IS NULL").count() == 9 and [r["warning"] for r in found.where("warning IS NOT NULL").collect()] == ["the capture ends early"]
    flows = K.packet_flows(found).collect()
    assert [(r["dst_addr"], r["port"], r["packets"], r["protocol"]) for r in flows] == [("10.0.0.1", 502, 9, "modbus")]
    got = K.reassemble(found).collect()
    assert len(got) == 3 and {r["identity"]["catalog_number"] for r in got} == {"AC-100"}
    cut = K.read_captures(spark, str(tmp_path), most=1)
    assert cut.where("warning IS NULL").count() == 3 and cut.where("warning LIKE 'stopped%'").count() == 3
    (port,) = K.open_ports(found, K.reassemble(found)).collect()
    assert (port["addr"], port["port"], port["protocol"]) == ("10.0.0.1", 502, "modbus")


def capture(path, frames):
    body = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for k, f in enumerate(frames):
        body += struct.pack("<IIII", 1_700_000_000 + k, 0, len(f), len(f)) + f
    path.write_bytes(body)


def udp(src, dst, sport, dport, payload):
    body = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0, 64, 17, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return b"\x02" * 6 + b"\x04" * 6 + b"\x08\x00" + ip + body


def test_only_listeners_are_decoded(spark, tmp_path):
    """A request is not a device; without a handshake a known port tells the server; both ends of equal known ports listen."""
    setup = struct.pack(">BBH", 3, 0, 25) + bytes([2, 0xF0, 0x80, 0x32, 1, 0, 0, 0, 1, 0, 8, 0, 0, 0xF0, 0, 0, 1, 0, 1, 1, 0xE0])
    capture(tmp_path / "a.pcap", [
        frame("10.0.0.9", "10.0.0.1", 50000, 102, setup), frame("10.0.0.1", "10.0.0.9", 102, 50000, s7_reply()), frame("10.0.0.2", "10.0.0.9", 44818, 40000, enip_reply()), udp("10.0.0.3", "10.0.0.4", 47808, 47808, bacnet_reply()),
        udp("10.0.0.5", "255.255.255.255", 5000, 47808, b"x"), frame("10.0.0.6", "10.0.0.9", 80, 50001, b"HTTP/1.1 200 OK\r\nDate: x\r\nServer:  Acme  Web/1.0\r\n\r\nServer: no"),
    ])
    found = K.read_captures(spark, str(tmp_path))
    assert {(r["server"], r["protocol"]) for r in K.reassemble(found).collect()} == {("10.0.0.1", "s7comm"), ("10.0.0.2", "enip"), ("10.0.0.3", "bacnet")}
    assert {(r["src_addr"], r["dst_addr"], r["port"]) for r in K.packet_flows(found).collect()} == {("10.0.0.9", "10.0.0.1", 102), ("10.0.0.9", "10.0.0.2", 44818), ("10.0.0.3", "10.0.0.4", 47808), ("10.0.0.9", "10.0.0.6", 80)}
    assert [(r["server"], r["banner"]) for r in K.http_banners(found).collect()] == [("10.0.0.6", "Acme Web/1.0")]
    assert {(r["addr"], r["port"], r["protocol"]) for r in K.open_ports(found, K.reassemble(found)).collect()} == {("10.0.0.1", 102, "s7comm"), ("10.0.0.2", 44818, "enip"), ("10.0.0.3", 47808, "bacnet"), ("10.0.0.6", 80, "http")}


def test_announcements(spark, tmp_path):
    """ARP and LLDP: bindings of one address each, a router's left out, and what a neighbour says of itself."""
    mac = lambda n: bytes([2, 0, 0, 0, 0, n])
    arp = lambda m, ip: b"\xff" * 6 + m + b"\x08\x06" + struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + m + bytes(map(int, ip.split("."))) + b"\0" * 6 + bytes([10, 0, 0, 99])
    tlv = lambda kind, value: struct.pack(">H", kind << 9 | len(value)) + value
    lldp = b"\x01\x80\xc2\0\0\x0e" + mac(1) + b"\x88\xcc" + tlv(1, b"\x04x") + tlv(5, b"switch-1") + tlv(6, b"Siemens, SCALANCE, 6GK5 208-0BA10-2AA3") + tlv(7, b"\0\x14\0\x04") + tlv(0, b"")
    capture(tmp_path / "a.pcap", [arp(mac(1), "10.0.0.1"), arp(mac(2), "10.0.0.2"), arp(mac(2), "10.0.0.3"), lldp])
    found = K.read_captures(spark, str(tmp_path))
    assert [(r["ip"], r["mac"]) for r in K.announcements(found).collect()] == [("10.0.0.1", "02:00:00:00:00:01")]
    (n,) = K.neighbours(found).collect()
    assert (n["ip"], n["name"], n["role"]) == ("10.0.0.1", "switch-1", "network-device") and "SCALANCE" in n["description"]


ZEEK = "#separator \\x09\n#set_separator\t,\n#empty_field\t(empty)\n#unset_field\t-\n#path\tconn\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\tconn_state\torig_pkts\torig_ip_bytes\tresp_pkts\tresp_ip_bytes\n1700000000.5\tC1\t10.0.0.9\t5000\t10.0.0.1\t502\ttcp\tmodbus\tSF\t5\t300\t4\t200\n1700000001\tC2\t10.0.0.9\t5001\t10.0.0.2\t80\ttcp\t-\tS0\t1\t40\t-\t-\n#close\n"


def test_zeek(spark, tmp_path):
    (tmp_path / "conn.2024.log").write_text(ZEEK)
    (tmp_path / "cip_identity.log").write_text(json.dumps({"ts": 1700000002.0, "id": {"orig_h": "10.0.0.9", "resp_h": "10.0.0.1"}, "id.note": {"x": {"y": 1.5}}, "vendor": "Rockwell", "product_name": "1234-ABC", "revision": "4.6", "tags": ["a", True, 2.0], "is_orig": False}) + "\n{broken\n")
    (tmp_path / "known_services.log").write_text("#separator \\x7c\n#set_separator|;\n#fields|ts|host|port_num|port_proto|service|service\n2023-11-14T22:13:20Z|10.0.0.7|102.0|tcp|x|s7;y\n#fields|ts|port_num|host\n1700000000|80|10.0.0.8\n")
    (tmp_path / "dhcp.log").write_text(json.dumps({"ts": 1, "mac": "02-00-00-00-00-05", "client_addr": "10.0.0.5", "host_name": "hmi"}) + "\n")
    (tmp_path / "software.log").write_text(json.dumps({"ts": 1, "host": "10.0.0.5", "software_type": "HTTP::SERVER", "unparsed_version": "Acme/1"}) + "\n")
    (tmp_path / "known_hosts.log").write_text(json.dumps({"ts": 1, "host": "10.0.0.6"}) + "\n" + json.dumps({"ts": 1, "host": "0.0.0.0"}) + "\n")
    with gzip.open(tmp_path / "dns.log.gz", "wt") as f:
        f.write("1\tno header\n")
    (tmp_path / "dns.2.log").write_text(json.dumps({"ts": 1, "qtype_name": "a", "query": "plc.example.", "answers": ["10.0.0.1", "alias.example"]}) + "\n")
    records = L.read_zeek(spark, str(tmp_path))
    assert {r["kind"] for r in records.where("record IS NOT NULL").collect()} == {"conn", "cip_identity", "known_services", "dhcp", "software", "known_hosts", "dns"}
    assert sorted(r["warning"][:8] for r in records.where("warning IS NOT NULL").collect()) == ["data bef", "not a JS"]
    nested = records.where("kind = 'cip_identity' AND record IS NOT NULL").first()["record"]
    assert (nested["id.resp_h"], nested["id.note.x.y"], nested["tags"], nested["is_orig"]) == ("10.0.0.1", "1.5", "a,T,2", "F")
    flows = {r["dst_addr"]: r for r in L.zeek_flows(records).collect()}
    assert flows["10.0.0.1"]["packets"] == 9 and flows["10.0.0.1"]["bytes"] == 500 and flows["10.0.0.2"]["protocol"] == "http"
    assert {(r["addr"], r["port"], r["protocol"]) for r in L.zeek_services(records).collect()} == {("10.0.0.1", 502, "modbus"), ("10.0.0.7", 102, "s7"), ("10.0.0.8", 80, "http")}
    (i,) = L.zeek_identities(records).collect()
    assert (i["addr"], i["facts"]) == ("10.0.0.1", {"vendor": "Rockwell", "product": "1234-ABC", "firmware": "4.6"})
    seen = L.zeek_observations(records).collect()
    named = [r for r in seen if r["vendor_raw"]]
    assert [(r["ipv4"], r["product_raw"], r["firmware_raw"], r["protocol"]) for r in named] == [("10.0.0.1", "1234-ABC", "4.6", "cip_identity")]
    assert {r["ipv4"] for r in seen} == {f"10.0.0.{k}" for k in (1, 2, 5, 6, 7, 8, 9)}
    assert [r["hostname"] for r in seen if r["ipv4"] == "10.0.0.1" and r["hostname"]] == ["plc.example"] and [r["mac"] for r in seen if r["mac"]] == ["02:00:00:00:00:05"]
    assert [dict(r["fields"]) for r in seen if r["protocol"] == "software"] == [{"zeek_software.HTTP::SERVER": "Acme/1"}]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        L.read_zeek(spark, str(tmp_path / "none"))


def test_zeek_times(spark):
    from pyspark.sql import functions as SF

    texts = ["1700000000.5", "2023-11-14T22:13:20Z", "2023-11-14 22:13:20", "2023-11-14T22:13:20.5+0000", "2023-11-14", "x", ""]
    got = [r["t"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select("k", L.epoch(SF.col("x")).alias("t")).orderBy("k").collect()]
    assert [g is not None for g in got] == [True, True, True, True, True, False, False] and got[1] == got[2]


NMAP = """<nmaprun start="1700000000"><host starttime="1700000000" endtime="1700000009"><status state="up"/><address addr="10.0.0.1" addrtype="ipv4"/><address addr="00:1B:1B:00:00:01" addrtype="mac" vendor="Siemens"/><hostnames><hostname name="plc1"/></hostnames><ports><port protocol="tcp" portid="102"><state state="open"/><service name="iso-tsap" product="S7" version="1"/><script id="s7-info" output="x"><elem key="Module">6ES7 999-0AA00-0XX0</elem><table key="t"><elem key="Version"> 2.7 </elem><table><elem key="Serial Number">S 1</elem></table></table></script></port><port protocol="tcp" portid="80"><state state="closed"/></port></ports></host><host><status state="down"/><address addr="10.0.0.2" addrtype="ipv4"/></host></nmaprun>"""


def test_nmap(spark, tmp_path):
    (tmp_path / "scan.xml").write_text(NMAP)
    hosts = L.read_nmap(spark, str(tmp_path))
    (host,) = hosts.collect()
    assert (host["ipv4"], host["mac"], host["hostname"], host["mac_vendor"]) == ("10.0.0.1", "00:1b:1b:00:00:01", "plc1", "Siemens")
    (s,) = host["services"]
    assert (s["port"], s["banner"], s["protocol"]) == (102, "S7 1", "s7comm") and host["facts"][0]["value"] == "6ES7 999-0AA00-0XX0"
    (o,) = L.nmap_observations(hosts).collect()
    assert (o["catalog_number"], o["firmware_raw"], o["serial"], o["fields"]["mac_oui_vendor"]) == ("6ES7 999-0AA00-0XX0", "2.7", "S 1", "Siemens")
    assert L.nmap_services(hosts).count() == 1
    (tmp_path / "late.xml").write_text('<nmaprun start="1700000000"><host><address addr="10.0.0.3" addrtype="ipv4"/></host></nmaprun>')
    (late,) = L.read_nmap(spark, str(tmp_path / "late.xml")).collect()
    assert late["seen"].timestamp() == 1_700_000_000


def test_feeds(spark, tmp_path):
    leaf = lambda key, name="4.5": {"category": "product_version", "name": name, "product": {"product_id": key, "name": key, "product_identification_helper": {"model_numbers": ["6ES7 214"]}}}
    tree = {"branches": [{"category": "vendor", "name": "Siemens", "branches": [{"category": "product_family", "name": "SIMATIC", "branches": [{"category": "product_name", "name": "S7-1200", "branches": [leaf("P1"), leaf("P1", "5")]}]}]}], "relationships": [{"product_reference": "P1", "full_product_name": {"product_id": "P2", "name": "P1 on rail"}}]}
    vulns = [{"ids": [{"system_name": "x", "text": "CVE-2020-1234"}], "product_status": {"known_affected": ["P1"]}, "scores": [{"products": ["P1"], "cvss_v3": {"version": "3.1", "vectorString": "CVSS:3.1/AV:N", "baseScore": 9.8, "baseSeverity": "CRITICAL"}}], "remediations": [{"category": "vendor_fix", "details": "update"}]}]
    (tmp_path / "csaf").mkdir()
    (tmp_path / "csaf" / "a.json").write_text(json.dumps({"document": {"title": "T", "publisher": {"name": "S"}, "tracking": {"id": "SSA-1", "initial_release_date": "2024-01-02T00:00:00Z"}}, "product_tree": tree, "vulnerabilities": vulns}))
    (tmp_path / "csaf" / "b.json").write_text("<!DOCTYPE html><html></html>")
    advisories = F.read_csaf(F.read_documents(spark, str(tmp_path / "csaf")))
    assert [r["advisory_id"] for r in advisories.collect()] == ["SSA-1"]
    products = {r["product_id"]: r for r in F.csaf_products(advisories).collect()}
    assert products["P1"]["version_raw"] == "4.5" and products["P1"]["warning"] and products["P2"]["vendor_raw"] == "Siemens"
    (v,) = F.csaf_vulnerabilities(advisories).collect()
    assert (v["cve"], v["affected"], v["cvss_version"], v["base_score"], v["has_fix"], v["severity"], v["remediations"][0]["details"]) == ("CVE-2020-1234", ["P1"], "3.1", 9.8, True, "critical", "update")
    (tmp_path / "csaf" / "c.json").write_text("{}")
    (tmp_path / "csaf" / "d.json").write_text((tmp_path / "csaf" / "a.json").read_text())
    assert sorted((r["file"][-6:], r["why"]) for r in F.csaf_rejects(F.landed(spark, str(tmp_path / "csaf"))).collect()) == [("b.json", "a web page"), ("c.json", "no tracking id"), ("d.json", "listed before")]
    (tmp_path / "kev").mkdir()
    (tmp_path / "kev" / "k.json").write_text(json.dumps({"vulnerabilities": [{"cveID": " cve-2021-44228", "dateAdded": "2021-12-10", "knownRansomwareCampaignUse": "KNOWN"}, {"cveID": "junk"}]}))
    (k,) = F.read_kev(F.read_documents(spark, str(tmp_path / "kev"))).collect()
    assert k["cve"] == "CVE-2021-44228" and k["ransomware"] and str(k["added"]) == "2021-12-10"
    with gzip.open(tmp_path / "epss.csv.gz", "wt") as f:
        f.write("#model_version:v1,score_date:2024-01-01\ncve,epss,percentile\nCVE-2021-44228,0.97,0.99\nCVE-2020-1234,bad,0.1\njunk,1,1\n")
    assert str(F.read_epss(spark, str(tmp_path / "epss.csv.gz")).first()["model_date"]) == "2024-01-01"
    assert {r["cve"]: r["score"] for r in F.read_epss(spark, str(tmp_path / "epss.csv.gz")).collect()} == {"CVE-2021-44228": 0.97, "CVE-2020-1234": 0.0}
    (tmp_path / "sheet.csv").write_text('icsad_ID,Products Affected\nA1,"PLC < 2.0 | HMI >= 1 | Name"\n')
    cells = sorted((r["place"], r["name"], r["version"]) for r in F.read_sheet(spark, str(tmp_path / "sheet.csv"), "ICSAD-ID", "products_affected").collect())
    assert cells == [(0, "PLC", "< 2.0"), (1, "HMI", ">= 1"), (2, "Name", "")]


def test_advisory_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        'ICS-CERT Number,ICS-CERT Advisory Title,Vendor,Product,Products Affected,CVE Number,Cumulative CVSS,CVSS Severity,CWE Number,Original Release Date\n'
        'ICSA-24-001,"A  title",Acme,M1,"M1 < 2.0 | >= 3 | M2","CVE-2024-0001, CVE-2024-0002;junk",9.8,,CWE-79,3/1/2024\nICSA-24-001,Later,Acme,M3,,CVE-2024-0001,1.0,,,\nICSA-24-002,B,Acme,,,CVE-2024-0003,0,,,2024-02-03\n,none,Acme,x,,,,,,\n'
    )
    got = {k: v.collect() for k, v in F.read_advisory_sheet(spark, str(tmp_path / "s.csv")).items()}
    assert {(r["advisory_id"], r["title"], str(r["published"])) for r in got["advisories"]} == {("ICSA-24-001", "A title", "2024-03-01"), ("ICSA-24-002", "B", "2024-02-03")}
    assert {(r["product_id"], r["name"], r["version_raw"]) for r in got["products"]} == {("ICSA-24-001-1", "Acme M1", "< 2.0"), ("ICSA-24-001-2", "Acme M2", ""), ("ICSA-24-001-3", "Acme M3", "")}
    by = {r["cve"]: r for r in got["vulnerabilities"]}
    assert (by["CVE-2024-0001"]["base_score"], by["CVE-2024-0001"]["severity"], by["CVE-2024-0001"]["cwe_id"]) == (9.8, "critical", "CWE-79") and len(by["CVE-2024-0002"]["affected"]) == 3 and by["CVE-2024-0003"]["base_score"] is None
    assert len(got["warnings"]) == 2
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        F.read_advisory_sheet(spark, str(tmp_path / "t.csv"))


def test_lookups_and_feeds(spark, tmp_path):
    metric = lambda kind, score: [{"type": kind, "cvssData": {"version": "3.1", "vectorString": "CVSS:3.1/x", "baseScore": score}}]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.json").write_text(json.dumps({"vulnerabilities": [{"cve": {"id": "CVE-2024-0001", "descriptions": [{"lang": "es", "value": "x"}, {"lang": "en", "value": "an  error"}], "weaknesses": [{"description": [{"lang": "en", "value": "NVD-none"}, {"lang": "en", "value": "CWE-20"}]}], "metrics": {"cvssMetricV31": metric("Primary", 7.5), "cvssMetricV30": metric("Secondary", 9.9)}}}]}))
    (tmp_path / "n" / "b.json").write_text(json.dumps({"vulnerabilities": []}))
    nvd = F.read_nvd(F.read_documents(spark, str(tmp_path / "n")))
    (r,) = nvd.collect()
    assert (r["cve"], r["description"], r["cwe_id"], r["base_score"], r["severity"], len(r["scores"])) == ("CVE-2024-0001", "an error", "CWE-20", 7.5, "high", 1)
    vulns = spark.createDataFrame([("CVE-2024-0001", None, None, None, None, None), ("CVE-2024-0001", "3.1", 5.0, "v", "medium", "CWE-1"), ("CVE-1", None, None, None, None, None)], "cve string, cvss_version string, base_score double, vector string, severity string, cwe_id string")
    assert sorted((r["cve"], r["base_score"] or 0, r["cwe_id"] or "", r["filled"]) for r in F.fill_from_nvd(vulns, nvd).collect()) == [("CVE-1", 0, "", False), ("CVE-2024-0001", 5.0, "CWE-1", False), ("CVE-2024-0001", 7.5, "CWE-20", True)]
    feed = {"feed": {"entry": [{"updated": "2024-05-01T00:00:00Z", "link": [{"rel": "hash", "href": "a.sha"}, {"rel": "self", "href": "https://x/a.json"}]}, {"updated": "2020-01-01T00:00:00Z", "link": [{"rel": "self", "href": "https://x/b.JSON"}]}, {"link": [{"rel": "self", "href": "https://x/c.json"}]}]}}
    feeds = spark.createDataFrame([(json.dumps(feed),)], "value string")
    assert {r["url"] for r in F.feed_documents(feeds, "2023-01-01").collect()} == {"https://x/a.json", "https://x/c.json"}
