"""What makes a file unsafe to open: archives, office parts, and nesting of XML and JSON. Nothing is unpacked to disk."""

from __future__ import annotations

import io
import unicodedata
import zipfile
import zlib
from dataclasses import dataclass
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MIB = 1 << 20


@dataclass(frozen=True)
class Policy:
    """The limits beyond which a file is a risk."""

    file_bytes: int = 2048 * MIB
    entries: int = 4096
    metadata_bytes: int = 16 * MIB
    unpacked_bytes: int = 1024 * MIB
    member_bytes: int = 256 * MIB
    ratio: float = 200.0
    gzip_bytes: int = 64 * MIB
    text_bytes: int = 4 * MIB
    depth: int = 128
    json_items: int = 100_000
    xml_elements: int = 100_000
    xml_attributes: int = 1024


#: A ratio counts from this many unpacked bytes on.
RATIO_FROM = MIB
#: Characters and device names that a file name must not hold or be on some system.
BAD_CHARACTERS = frozenset('<>:"|?*') | {chr(i) for i in range(32)}
DEVICES = frozenset(["con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))])


def unsafe_name(name: str) -> bool:
    """A member's path that could leave its folder or means something else on another system."""
    parts = name.replace("\\", "/").split("/")
    if not name or parts[0] == "" or "" in parts[:-1]:
        return True
    for part in filter(None, parts):
        folded = unicodedata.normalize("NFC", part).casefold()
        if part.strip(".") == "" or part[-1] in " ." or BAD_CHARACTERS & set(folded) or folded.split(".")[0].strip() in DEVICES:
            return True
    return False


def _landing(name: str) -> str:
    """Where a member comes to lie, alike for names that meet in one file."""
    out: list[str] = []
    for part in name.replace("\\", "/").split("/"):
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part not in ("", "."):
            out.append(unicodedata.normalize("NFC", part).casefold().rstrip(" ."))
    return "/".join(out)


def zip_risks(raw: bytes, policy: Policy = Policy()) -> set[str]:
    try:
        # The end record tells the size of the directory before any of it is parsed.
        end = raw.rfind(b"PK\x05\x06", max(0, len(raw) - 65_557))
        told, size = int.from_bytes(raw[end + 10 : end + 12], "little"), int.from_bytes(raw[end + 12 : end + 16], "little")
        early = {"archive_too_many_entries"} if end >= 0 and told > policy.entries and told != 0xFFFF else set()
        if end >= 0 and size > policy.metadata_bytes and size != 0xFFFFFFFF:
            early.add("archive_metadata_too_large")
        if early:
            return early
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            members = archive.infolist()
    except (zipfile.BadZipFile, ValueError, OSError, RuntimeError, NotImplementedError):
        return {"malformed_archive"}
    found = set()
    if told not in (len(members), 0xFFFF):
        found.add("malformed_archive")
    if len(members) > policy.entries:
        return found | {"archive_too_many_entries"}
    places = [_landing(m.filename) for m in members]
    heavy = lambda plain, packed: plain >= RATIO_FROM and plain / max(1, packed) > policy.ratio
    plain, packed = sum(m.file_size for m in members), sum(m.compress_size for m in members)
    tests = {
        "archive_duplicate_entry": len(set(places)) < len(places),
        "archive_encrypted_member": any(m.flag_bits & 1 for m in members),
        "archive_member_too_large": any(m.file_size > policy.member_bytes for m in members),
        "archive_too_large": plain > policy.unpacked_bytes,
        "archive_high_compression_ratio": heavy(plain, packed) or any(heavy(m.file_size, m.compress_size) for m in members),
        # The reader cuts a name at a null, so the name as it was written is judged.
        "archive_path_traversal": any(unsafe_name(m.orig_filename) for m in members),
        "archive_symlink": any((m.external_attr >> 28) & 0xF == 0xA for m in members),
        "office_macro": any(p.endswith("vbaproject.bin") for p in places),
        "office_external_link": any(p.startswith("xl/externallinks/") for p in places),
        "office_external_data": any(p == "xl/connections.xml" or p.startswith("xl/querytables/") for p in places),
    }
    return found | {code for code, holds in tests.items() if holds}


def gzip_risks(raw: bytes, policy: Policy = Policy()) -> set[str]:
    """Every member is unpacked in pieces that are dropped at once; zeros may follow a member, nothing else may."""
    if len(raw) > policy.gzip_bytes:
        return {"archive_scan_budget_exceeded"}
    rest, members, plain, packed = memoryview(raw), 0, 0, 0
    try:
        while len(rest):
            if members == policy.entries:
                return {"archive_too_many_entries"}
            inflate, size, held = zlib.decompressobj(16 + zlib.MAX_WBITS), 0, rest
            while not inflate.eof:
                before = len(held)
                out = len(inflate.decompress(held, MIB))
                held = memoryview(inflate.unconsumed_tail)
                size, plain = size + out, plain + out
                limits = {"archive_member_too_large": size > policy.member_bytes, "archive_too_large": plain > policy.unpacked_bytes}
                if any(limits.values()):
                    return {code for code, over in limits.items() if over}
                if not inflate.eof and not out and len(held) in (0, before):
                    return {"malformed_archive"}
            used = len(rest) - len(inflate.unused_data)
            members, packed = members + 1, packed + used
            if size >= RATIO_FROM and size / used > policy.ratio:
                return {"archive_high_compression_ratio"}
            after = bytes(inflate.unused_data).lstrip(b"\0")
            rest = memoryview(after)
    except zlib.error:
        return {"malformed_archive"}
    if not members:
        return {"malformed_archive"}
    return {"archive_high_compression_ratio"} if plain >= RATIO_FROM and plain / packed > policy.ratio else set()


class _Over(Exception):
    pass


def xml_risks(raw: bytes, policy: Policy = Policy()) -> set[str]:
    """The first limit that a document exceeds; one that does not parse has none of these risks."""
    depth = elements = 0

    def opened(_, attributes) -> None:
        nonlocal depth, elements
        depth, elements = depth + 1, elements + 1
        for code, over in (
            ("xml_too_many_attributes", len(attributes) > policy.xml_attributes),
            ("xml_nesting_too_deep", depth > policy.depth),
            ("xml_too_many_elements", elements > policy.xml_elements),
        ):
            if over:
                raise _Over(code)

    def closed(_) -> None:
        nonlocal depth
        depth -= 1

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    try:
        parser.Parse(raw[: policy.text_bytes], len(raw) <= policy.text_bytes)
    except _Over as over:
        return {str(over)}
    except expat.ExpatError:
        pass
    return set()


def json_risks(text: str, policy: Policy = Policy()) -> set[str]:
    """Depth and values of a JSON text, counted without recursion."""
    depth = items = 0
    inside = False
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if inside:
            at += 1 if c == "\\" else 0
            inside = c != '"' or c == "\\"
        elif c == '"':
            inside = True
        elif c in "[{":
            depth, items = depth + 1, items + 1
        elif c in "]}":
            depth -= 1
        elif c == ",":
            items += 1
        if depth > policy.depth:
            return {"json_nesting_too_deep"}
        if items > policy.json_items:
            return {"json_too_many_items"}
        at += 1
    return set()


def file_risks(raw: bytes, kind: str, policy: Policy = Policy()) -> list[str]:
    """Sorted codes for one file's bytes and its kind by content."""
    found = {"file_too_large"} if len(raw) > policy.file_bytes else set()
    if raw[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        found |= zip_risks(raw, policy)
    elif raw[:2] == b"\x1f\x8b":
        found |= gzip_risks(raw, policy)
    elif kind == "xml":
        found |= xml_risks(raw, policy)
    elif raw.lstrip()[:1] in (b"{", b"[") and len(raw) <= policy.text_bytes:
        found |= json_risks(raw.decode("utf-8", "replace"), policy)
    return sorted(found)


def risks(spark: SparkSession, path: str, policy: Policy = Policy()) -> DataFrame:
    """path, length, kind and risks (sorted codes, empty for a safe file) of files. Files beyond the size limit are not read;
    empty files have no row, as Spark's reader passes over them."""
    files = spark.read.format("binaryFile").load(path)
    large = files.filter(files["length"] > policy.file_bytes).selectExpr("path", "length", "cast(null as string) as kind", "array('file_too_large') as risks")

    def look(batches):
        from weftline.sources.files import content_kind

        for pdf in batches:
            kinds, codes = [], []
            for content in pdf["content"]:
                raw = bytes(content)
                unsafe = file_risks(raw, "xml" if raw.lstrip()[:1] == b"<" else "", policy)
                # A file with a risk is not parsed further.
                kinds.append(None if unsafe and raw[:2] != b"PK" else content_kind(raw))
                codes.append(unsafe)
            yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "kind": kinds, "risks": codes})

    fitting = files.filter(files["length"] <= policy.file_bytes).select("path", "length", "content")
    return fitting.mapInPandas(look, "path string, length long, kind string, risks array<string>").unionByName(large)
