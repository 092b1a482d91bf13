"""Scalar functions: byte formatting, integer helpers, keys, hashes, enum maps."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit flags of an artifact's capabilities.
CAPABILITIES = {
    "network": 1,
    "filesystem": 2,
    "registry": 4,
    "process": 8,
    "crypto": 16,
    "keylogger": 32,
    "injection": 64,
    "persistence": 128,
    "evasion": 256,
    "exfiltration": 512,
}
#: Names that the ingest interface maps; others become custom, raw or unknown.
EVENT_TYPES = ("ProcessStart", "NetworkConnection", "Authentication", "MalwareDetected", "FileCreate")
FORMATS = ("OCSF", "Zeek", "Suricata")
FILE_TYPES = ("PE", "ELF", "Script")
#: Key prefix of each kind.
PREFIX = {"log": 1, "code": 2, "index": 3}
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def format_bytes(n: Column, largest: str = "PB") -> Column:
    """B to ``largest`` by 1024; no decimals from 100 on, one from 10 on, else two; 0 is ``0 B``."""
    units = BYTE_UNITS[: BYTE_UNITS.index(largest) + 1]
    exp = F.when(n < 1024, 0)
    for i in range(2, len(units)):
        exp = exp.when(n < 1024**i, i - 1)
    exp = exp.otherwise(len(units) - 1)
    size = n.cast("double") / F.pow(F.lit(1024.0), exp)
    unit = F.element_at(F.array(*[F.lit(u) for u in units]), exp + 1)
    # ties go to the even digit
    show = lambda d: F.format_string(f"%.{d}f", F.bround(size, d))
    # beyond 53 bits format_string fills up with zeros; such a double is whole, and its parts of 53 bits give all digits
    part = lambda e: (size % 2.0 ** (e + 53) / 2.0**e).cast("long").cast("decimal(20,0)") * F.lit(Decimal(2**e))
    whole = (part(106) + part(53) + part(0)).cast("string")
    text = F.when(n == 0, F.lit("0")).when(size >= 2.0**53, whole).when(size <= -(2.0**53), F.concat(whole, F.lit(".00")))
    text = text.when(size >= 100, show(0)).when(size >= 10, show(1)).otherwise(show(2))
    return F.concat(text, F.lit(" "), unit)


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def next_power_of_two(n: Column) -> Column:
    """The least power of two not below ``n``; 1 for 0."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1))))


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n) == 1)


def align_to(n: Column, step: int) -> Column:
    return F.floor((n + (step - 1)) / step) * step


def storage_key(prefix: int, time_ns: Column, hi: Column, lo: Column) -> Column:
    """25 bytes, big-endian, in hex: kind, time, both halves of the id; its order is that of the parts."""
    part = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.lower(F.concat(F.lit(f"{prefix:02x}"), part(time_ns), part(hi), part(lo)))


def hash_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def parse_hash(text: Column) -> Column:
    """32 bytes of hex, else null."""
    raw = F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(text))
    return F.when(F.octet_length(raw) == 32, raw)


def has_capability(flags: Column, mask: int) -> Column:
    """Any bit of ``mask``."""
    return flags.bitwiseAND(F.lit(mask)) != 0


def api_event_type(name: Column) -> Column:
    return F.when(name.isin(*EVENT_TYPES), name).otherwise(F.concat(F.lit('Custom("'), name, F.lit('")')))


def api_format(name: Column) -> Column:
    return F.when(name.isin(*FORMATS), name).otherwise(F.lit("Raw"))


def api_file_type(name: Column) -> Column:
    return F.when(name.isin(*FILE_TYPES), name).otherwise(F.lit("Unknown"))
