"""Decoders of identity responses: Modbus/TCP, EtherNet/IP, S7comm and BACnet/IP. Pure functions of bytes, and an Arrow-batched operator over them.

A decoder returns an observation, or a verdict: not-this-protocol, truncated, or device-error with its code and detail.
Nothing here opens a connection.
"""

from __future__ import annotations

import socket
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


class NotThisProtocol(Exception):
    pass


class Truncated(Exception):
    pass


@dataclass
class Observation:
    protocol: str
    fields: dict[str, str] = field(default_factory=dict)
    identity: dict[str, str] = field(default_factory=dict)
    role: str = ""
    #: code and detail of an error that the device answered with
    error: tuple[int, str] | None = None
    notes: list[str] = field(default_factory=list)

    def put(self, name: str, value: object, *identity: str) -> None:
        """A field, and identity fields that take its value; empty values are left out."""
        if str(value):
            self.fields[name] = str(value)
            self.identity.update(dict.fromkeys(identity, str(value)))


def printable(raw: bytes) -> str:
    """ASCII text with white space collapsed; zeros are dropped, other bytes part words."""
    return " ".join("".join(chr(b) if 32 <= b < 127 else " " for b in raw if b).split())


class Cursor:
    """Reads bytes in order; reading beyond the end raises `short`."""

    def __init__(self, raw: bytes, short: type[Exception] = Truncated) -> None:
        self.raw, self.at, self.short = raw, 0, short

    @property
    def left(self) -> int:
        return len(self.raw) - self.at

    def take(self, n: int) -> bytes:
        if n > self.left:
            raise self.short
        self.at += n
        return self.raw[self.at - n : self.at]

    def big(self, n: int = 1) -> int:
        return int.from_bytes(self.take(n), "big")

    def little(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")


# Modbus exception codes, and names of identification objects with the identity fields they fill.
MODBUS_ERRORS = {1: "illegal function", 2: "illegal data address", 3: "illegal data value", 4: "slave device failure", 5: "acknowledge", 6: "slave device busy", 8: "memory parity error", 10: "gateway path unavailable", 11: "gateway target device failed to respond"}
MODBUS_OBJECTS = {
    0: ("vendor_name", ["vendor_raw", "vendor"]), 1: ("product_code", ["catalog_number"]), 2: ("major_minor_revision", ["firmware_raw", "firmware"]), 3: ("vendor_url", []),
    4: ("product_name", ["product_raw", "product"]), 5: ("model_name", ["model"]), 6: ("user_application_name", []),
}


def modbus(raw: bytes) -> Observation:
    """The first frame's device identification (function 43, type 14), an exception, or another function's number. Frames must fill the payload."""
    frames = Cursor(raw)
    if not raw:
        raise NotThisProtocol
    while frames.left:
        head = frames.take(6)
        length = int.from_bytes(head[4:], "big")
        if head[2:4] != b"\0\0" or not 3 <= length <= 260:
            raise NotThisProtocol
        frames.take(length)
    r, out = Cursor(raw), Observation("modbus")
    out.put("transaction_id", r.big(2))
    r.take(4)
    out.put("unit_id", r.big())
    function = r.big()
    if function & 0x80:
        code = r.big()
        out.put("exception_code", code)
        out.error = (code, MODBUS_ERRORS.get(code, "undocumented exception code"))
        out.notes.append(f"function {function & 0x7F} was refused: {out.error[1]}")
        return out
    if function != 43:
        out.put("function_code", function)
        out.notes.append(f"function {function} tells nothing of the device")
        return out
    if r.big() != 14:
        raise NotThisProtocol
    out.put("read_device_id_code", r.big())
    out.put("conformity_level", f"0x{r.big():02x}")
    more, following, count = r.big(), r.big(), r.big()
    if more == 0xFF:
        out.put("next_object_id", following)
        out.notes.append(f"more objects follow from {following}")
    try:
        for _ in range(count):
            key = r.big()
            name, identity = MODBUS_OBJECTS.get(key, (f"object_0x{key:02x}", []))
            out.put(name, printable(r.take(r.big())), *identity)
    except Truncated:
        out.notes.append(f"the list of {count} objects ends early")
    if "product_raw" not in out.identity and "model" in out.identity:
        out.identity |= dict.fromkeys(("product_raw", "product"), out.identity["model"])
    return out


# Commands that devices answer with, states, and the vendor and device types of CIP.
ENIP_COMMANDS = {0x0004, 0x0063, 0x0064, 0x0065, 0x0066, 0x006F, 0x0070, 0x0072, 0x0073}
ENIP_ERRORS = {0x01: "sender issued an invalid or unsupported encapsulation command", 0x02: "receiver had insufficient memory", 0x03: "poorly formed or incorrect data in the request", 0x64: "invalid session handle", 0x65: "invalid message length", 0x69: "unsupported encapsulation protocol revision"}
CIP_VENDORS = {1: "Rockwell Automation/Allen-Bradley"}
CIP_TYPES = {0x02: "AC Drive", 0x07: "General Purpose Discrete I/O", 0x0C: "Communications Adapter", 0x0E: "Programmable Logic Controller"}
#: Bytes of the longest body of an encapsulated message that is read.
ENIP_MOST = 4096


def leading_code(name: str) -> str:
    """An order code at the start of a product name: up to a space or slash, six characters or more with a hyphen and three digits."""
    word = name.split(" ")[0]
    code = word.split("/")[0] or word
    return code if "-" in code and len(code) >= 6 and sum("0" <= c <= "9" for c in code) >= 3 else ""


def enip(raw: bytes) -> Observation:
    """The first CIP identity item of a List Identity reply; other commands give their number."""
    r = Cursor(raw, NotThisProtocol)
    command, length, session, status = r.little(2), r.little(2), r.little(4), r.little(4)
    r.take(12)
    if command not in ENIP_COMMANDS:
        raise NotThisProtocol
    if length > min(r.left, ENIP_MOST):
        raise Truncated
    r.short = Truncated
    out = Observation("enip")
    if command != 0x63:
        out.put("encapsulation_command", f"0x{command:04x}")
        out.notes.append("the command tells nothing of the device")
        return out
    if status:
        out.error = (status, ENIP_ERRORS.get(status, "undocumented encapsulation status"))
        return out
    if session:
        out.put("session_handle", f"0x{session:08x}")
    for _ in range(r.little(2)):
        try:
            kind = r.little(2)
            item = r.take(r.little(2))
        except Truncated:
            out.notes.append("the list of items ends early")
            break
        if kind == 0x0C:
            try:
                _cip_identity(Cursor(item), out)
            except Truncated:
                out.notes.append("the identity item ends early")
            break
        out.notes.append(f"item of type 0x{kind:04x} passed over")
    return out


def _cip_identity(r: Cursor, out: Observation) -> None:
    out.put("encapsulation_protocol_version", r.little(2))
    r.take(2)
    port, address = r.big(2), socket.inet_ntoa(r.take(4))
    if port:
        out.put("reported_socket_address", f"{address}:{port}")
    r.take(8)
    vendor, device, product, major, minor, state, serial = r.little(2), r.little(2), r.little(2), r.big(), r.big(), r.little(2), r.little(4)
    name = printable(r.take(r.big()))
    out.put("vendor_id", vendor)
    out.put("device_type", device)
    out.put("product_code", product)
    out.put("revision", f"{major}.{minor}", "firmware_raw", "firmware")
    out.put("device_status", f"0x{state:04x}")
    out.put("serial_number", f"{serial:08X}", "serial")
    out.put("product_name", name, "product_raw", "product")
    if r.left:
        out.put("device_state", f"0x{r.big():02x}")
    out.put("device_type_name", CIP_TYPES.get(device, ""))
    if device == 0x0E:
        out.role = "plc"
    out.put("vendor_name", CIP_VENDORS.get(vendor, ""), "vendor_raw", "vendor")
    if vendor not in CIP_VENDORS:
        out.notes.append(f"vendor {vendor} has no name here")
    out.put("catalog_number_from_product_name", leading_code(name), "catalog_number")


# Indexes of the component list of S7 devices, with the identity fields they fill.
S7_COMPONENTS = {
    1: ("automation_system_name", []), 2: ("module_name", []), 3: ("plant_designation", []), 4: ("copyright", []), 5: ("module_serial_number", ["serial"]), 7: ("module_type_name", ["product_raw", "product"]),
    8: ("memory_card_serial_number", []), 9: ("cpu_manufacturer_profile", []), 10: ("oem_id", []), 11: ("location_designation", []),
}
#: Bytes of the longest frame.
S7_MOST = 4096


def s7comm(raw: bytes) -> Observation:
    """A COTP confirm, a set-up acknowledgement, or the records of system lists 0x0011 and 0x001C."""
    r = Cursor(raw, NotThisProtocol)
    if r.big() != 3:
        raise NotThisProtocol
    r.take(1)
    if not 4 <= r.big(2) <= S7_MOST:
        raise NotThisProtocol
    r.short = Truncated
    out = Observation("s7comm")
    size, kind = r.big(), r.big()
    if kind == 0xD0:
        out.put("cotp_response", "connection confirm")
        out.notes.append("the device takes ISO-on-TCP connections")
        return out
    if kind != 0xF0:
        raise NotThisProtocol
    r.take(max(size - 1, 0))
    if not r.left or r.big() != 0x32:
        raise NotThisProtocol
    message = r.big()
    r.take(4)
    n_param, n_data = r.big(2), r.big(2)
    if message in (2, 3):
        group, code = r.big(), r.big()
        if group or code:
            out.error = (group << 8 | code, f"error class 0x{group:02x} code 0x{code:02x}")
            return out
    param, data = r.take(n_param), r.take(n_data)
    if message == 3 and param[:1] == b"\xf0":
        if len(param) >= 8:
            out.put("negotiated_pdu_length", int.from_bytes(param[6:8], "big"))
        out.notes.append("the device took the set-up of communication")
    elif message != 7:
        out.put("rosctr", f"0x{message:02x}")
        out.notes.append("the message tells nothing of the device")
    else:
        _system_list(Cursor(data), out)
    return out


def _system_list(r: Cursor, out: Observation) -> None:
    code = r.big()
    if code != 0xFF:
        out.error = (code, f"SZL read returned code 0x{code:02x}")
        return
    r.take(3)
    name, index, width, count = r.big(2), r.big(2), r.big(2), r.big(2)
    out.put("szl_id", f"0x{name:04X}")
    out.put("szl_index", f"0x{index:04X}")
    if not width or not count:
        out.notes.append("the list has no records")
        return
    if width > len(r.raw):
        raise Truncated
    whole = min(count, r.left // width)
    records = [r.take(width) for _ in range(whole)]
    if whole < count:
        out.notes.append(f"the list ends after {whole} of {count} records")
    if name not in (0x11, 0x1C):
        return
    if name == 0x11:
        for record in records:
            if width >= 28 and record[:2] == b"\0\1":
                out.put("module_order_number", printable(record[2:22]), "catalog_number")
                if any(record[25:28]):
                    out.put("module_firmware_version", "V{}.{}.{}".format(*record[25:28]), "firmware", "firmware_raw")
                break
    else:
        for record in records if width > 2 else ():
            place = int.from_bytes(record[:2], "big")
            label, identity = S7_COMPONENTS.get(place, (f"component_0x{place:04X}", []))
            text = printable(record[2:])
            if place == 2 and text and "product_raw" not in out.identity:
                identity = ["product_raw", "product"]
            out.put(label, text, *identity)
    out.identity |= {"vendor_raw": "Siemens", "vendor": "Siemens"}
    out.role = "plc"


# Properties of BACnet devices, with the identity fields they fill.
BACNET_PROPERTIES = {
    77: ("object_name", []), 121: ("vendor_name", ["vendor_raw", "vendor"]), 120: ("vendor_identifier", []), 70: ("model_name", ["product_raw", "product"]), 44: ("firmware_revision", ["firmware_raw", "firmware"]), 12: ("application_software_version", ["firmware_raw", "firmware"]),
    372: ("serial_number", ["serial"]), 98: ("protocol_version", []), 139: ("protocol_revision", []), 112: ("system_status", []), 58: ("location", []), 28: ("description", []),
}
#: Bytes of the longest frame.
BACNET_MOST = 1500


def _value(r: Cursor) -> int | str | None:
    """An application-tagged number (unsigned or enumerated) or text; None for other kinds."""
    tag = r.big()
    size = tag & 7
    if size == 5:
        size = r.big()
    content = r.take(size)
    match tag >> 4:
        case 2 | 9:
            return int.from_bytes(content[-4:], "big")
        case 7:
            return printable(content[1:])
    return None


def bacnet(raw: bytes) -> Observation:
    """An I-Am, a ReadProperty acknowledgement, or an error, reject or abort."""
    r = Cursor(raw, NotThisProtocol)
    if r.big() != 0x81:
        raise NotThisProtocol
    function = r.big()
    if not 4 <= r.big(2) <= BACNET_MOST or r.big() != 1:
        raise NotThisProtocol
    r.short = Truncated
    control = r.big()
    for bit in (0x20, 0x08):
        if control & bit:
            r.take(2)
            r.take(r.big())
    if control & 0x20:
        r.take(1)
    out = Observation("bacnet")
    out.put("bvll_function", f"0x{function:02x}")
    kind = r.big() & 0xF0
    if kind == 0x10:
        if r.big():
            out.notes.append("the service tells nothing of the device")
        else:
            _i_am(r, out)
    elif kind == 0x30:
        r.take(1)
        if r.big() == 0x0C:
            _property(r, out)
        else:
            out.notes.append("the service is not read here")
    elif kind == 0x50:
        r.take(2)
        try:
            group, code = _value(r), _value(r)
        except Truncated:
            out.error = (0, "malformed error PDU")
            return out
        text = lambda v: "" if v is None else str(v)
        out.put("error_class", text(group))
        out.put("error_code", text(code))
        out.error = (code if isinstance(code, int) else 0, f"error class {text(group)}")
    elif kind in (0x60, 0x70):
        r.take(1)
        reason = r.big()
        out.put("reject_reason", reason)
        out.error = (reason, f"request {'rejected' if kind == 0x60 else 'aborted'} with reason {reason}")
    else:
        out.put("pdu_type", f"0x{kind:02x}")
    return out


def _i_am(r: Cursor, out: Observation) -> None:
    if r.big() != 0xC4:
        raise NotThisProtocol
    device = r.big(4)
    out.put("device_instance", device & 0x3FFFFF)
    if device >> 22 == 8:
        out.role = "building-controller"
    try:
        tags = [(r.raw[r.at : r.at + 1], _value(r)) for _ in range(3)]
    except Truncated:
        return
    if tags[2][0][:1] and tags[2][0][0] >> 4 == 2:
        out.put("vendor_identifier", tags[2][1])


def _property(r: Cursor, out: Observation) -> None:
    if not r.left or r.big() != 0x0C:
        raise NotThisProtocol
    r.take(4)
    tag = r.big()
    if tag & 0xF8 != 0x18:
        raise NotThisProtocol
    key = r.big(tag & 7)
    opening = r.big()
    if opening & 0xF8 == 0x28:  # an array's index stands before the value
        r.take(opening & 7)
        opening = r.big() if r.left else 0
    if opening != 0x3E:
        raise NotThisProtocol
    value = _value(r)
    name, identity = BACNET_PROPERTIES.get(key, (f"property_{key}", []))
    if isinstance(value, int):
        identity = []
    out.put(name, "" if value is None else value, *identity)
    out.role = "building-controller"


DECODERS = {"modbus": modbus, "enip": enip, "s7comm": s7comm, "bacnet": bacnet}
# The ports that name one decoder; elsewhere all are tried in the order above.
BY_PORT = {502: "modbus", 44818: "enip", 102: "s7comm", 47808: "bacnet"}


def decode(raw: bytes, port: int | None = None, further: bool = False) -> tuple[str, Observation | None]:
    """(verdict, observation) of the port's decoder, or of the first one that does not pass the bytes over. further: truncated frames, and observations that tell nothing, are passed over too."""
    verdict = "not-this-protocol"
    for name in [BY_PORT[port]] if port in BY_PORT else DECODERS:
        try:
            got = DECODERS[name](raw)
            if further and not got.fields and not got.identity:
                continue
            return ("device-error" if got.error else "decoded"), got
        except Truncated:
            verdict = "truncated"
            if not further:
                break
        except NotThisProtocol:
            continue
    return verdict, None


DECODED = "verdict string, protocol string, error_code int, error string, role string, fields map<string,string>, identity map<string,string>, notes array<string>"
_TEXT = pa.map_(pa.string(), pa.string())
DECODED_TYPES = [("verdict", pa.string()), ("protocol", pa.string()), ("error_code", pa.int32()), ("error", pa.string()), ("role", pa.string()), ("fields", _TEXT), ("identity", _TEXT), ("notes", pa.list_(pa.string()))]


def as_row(verdict: str, seen: Observation | None) -> dict:
    if seen is None:
        return {"verdict": verdict}
    code, detail = seen.error or (None, None)
    return {"verdict": verdict, "protocol": seen.protocol, "error_code": code, "error": detail, "role": seen.role or None, "fields": list(seen.fields.items()), "identity": list(seen.identity.items()), "notes": seen.notes}


def decode_payloads(payloads: DataFrame) -> DataFrame:
    """payloads (id, port, payload) decoded in Arrow batches; null payloads are no protocol's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [as_row(*decode(raw or b"", port)) for raw, port in zip(batch.column("payload").to_pylist(), batch.column("port").to_pylist(), strict=True)]
            made = pa.RecordBatch.from_pylist(rows, schema=pa.schema(DECODED_TYPES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made.columns], names=["id", *made.schema.names])

    kind = payloads.schema["id"].dataType.simpleString()
    return payloads.select("id", "port", "payload").mapInArrow(run, f"id {kind}, {DECODED}")
