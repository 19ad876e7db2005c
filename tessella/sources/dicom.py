"""Headers and pixels of DICOM files, read from bytes: little-endian files, explicit or implicit, whose pixels are not compressed.

A reader of the tags that films need, not of the whole standard: sequences are passed over, other encodings are errors.
"""

from __future__ import annotations

import struct

import numpy as np

# The tags that films need, their keywords, and transfer syntaxes whose pixels are plain.
KEYWORDS = {
    0x00020003: "MediaStorageSOPInstanceUID", 0x00020010: "TransferSyntaxUID", 0x00020012: "ImplementationClassUID", 0x00020013: "ImplementationVersionName", 0x00020016: "SourceApplicationEntityTitle", 0x00020100: "PrivateInformationCreatorUID",
    0x00080008: "ImageType", 0x00080018: "SOPInstanceUID", 0x00080020: "StudyDate", 0x00080030: "StudyTime", 0x00080050: "AccessionNumber", 0x00080060: "Modality", 0x00080080: "InstitutionName", 0x00080090: "ReferringPhysicianName",
    0x00100010: "PatientName", 0x00100020: "PatientID", 0x00100030: "PatientBirthDate", 0x00100040: "PatientSex", 0x00101010: "PatientAge", 0x00180015: "BodyPartExamined", 0x00185101: "ViewPosition", 0x0020000D: "StudyInstanceUID", 0x00200020: "PatientOrientation",
    0x00280002: "SamplesPerPixel", 0x00280004: "PhotometricInterpretation", 0x00280006: "PlanarConfiguration", 0x00280008: "NumberOfFrames", 0x00280010: "Rows", 0x00280011: "Columns", 0x00280030: "PixelSpacing", 0x00280100: "BitsAllocated", 0x00280101: "BitsStored", 0x00280102: "HighBit",
    0x00280103: "PixelRepresentation", 0x00281050: "WindowCenter", 0x00281051: "WindowWidth", 0x00281052: "RescaleIntercept", 0x00281053: "RescaleSlope",
}
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
LONG_FORM = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT", b"SV", b"UV"}
NUMBERS = {b"US": "<H", b"SS": "<h", b"UL": "<I", b"SL": "<i", b"FL": "<f", b"FD": "<d"}
SHORTS = {0x00280002, 0x00280006, 0x00280010, 0x00280011, 0x00280100, 0x00280101, 0x00280102, 0x00280103}
PIXELS, UNKNOWN = 0x7FE00010, 0xFFFFFFFF
ITEM_END, SEQUENCE_END = 0xFFFEE00D, 0xFFFEE0DD


class Incomplete(ValueError):
    """The bytes end within the file."""


def _element(data: bytes, at: int, explicit: bool) -> tuple[int, bytes, int, int]:
    """Tag, VR (empty where implicit), length and place of the value of the element at a place."""
    if at + 8 > len(data):
        raise Incomplete("the header is cut off")
    group, element = struct.unpack_from("<HH", data, at)
    tag = group << 16 | element
    if not explicit or group == 0xFFFE:
        return tag, b"", struct.unpack_from("<I", data, at + 4)[0], at + 8
    kind = data[at + 4 : at + 6]
    if kind in LONG_FORM:
        if at + 12 > len(data):
            raise Incomplete("the header is cut off")
        return tag, kind, struct.unpack_from("<I", data, at + 8)[0], at + 12
    return tag, kind, struct.unpack_from("<H", data, at + 6)[0], at + 8


def _past(data: bytes, at: int, explicit: bool, end: int) -> int:
    """The place after a sequence or item of unknown length."""
    while True:
        tag, kind, size, value = _element(data, at, explicit)
        at = value
        if tag == end:
            return at
        if size == UNKNOWN:
            at = _past(data, at, explicit, ITEM_END if tag == 0xFFFEE000 else SEQUENCE_END)
        else:
            at += size


def _plain(tag: int, kind: bytes, raw: bytes) -> str:
    form = NUMBERS.get(kind) or ("<H" if tag in SHORTS and len(raw) == 2 else None)
    if form and raw and len(raw) % struct.calcsize(form) == 0:
        return "\\".join(str(x[0]) for x in struct.iter_unpack(form, raw))
    return raw.rstrip(b"\x00 ").decode("utf-8", "replace")


def header(data: bytes) -> tuple[dict[str, str], dict[str, str], int, int]:
    """Tags, meta tags, and place and length of the pixels (-1 without any). Nothing after the pixels is read."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    tags: dict[str, str] = {}
    meta: dict[str, str] = {}
    at, explicit = 132, True
    while at < len(data):
        group = struct.unpack_from("<H", data, at)[0] if at + 2 <= len(data) else 0
        if group != 2:
            syntax = meta.get("TransferSyntaxUID", EXPLICIT)
            if syntax not in (IMPLICIT, EXPLICIT):
                raise ValueError(f"transfer syntax {syntax} is not read")
            explicit = syntax == EXPLICIT
        tag, kind, size, value = _element(data, at, explicit or group == 2)
        if tag == PIXELS:
            return tags, meta, value, size
        if size == UNKNOWN:
            at = _past(data, value, explicit, SEQUENCE_END)
            continue
        if value + size > len(data):
            raise Incomplete("the header is cut off")
        if (name := KEYWORDS.get(tag)) is not None:
            (meta if group == 2 else tags)[name] = _plain(tag, kind, data[value : value + size])
        at = value + size
    return tags, meta, -1, 0


def read(path: str, data: bytes) -> dict:
    """tags, meta and pixels (two-dimensional) of a file; raises where it holds several frames, colours, or too few bytes."""
    tags, meta, at, size = header(data)
    if at < 0:
        raise ValueError("no pixels")
    number = lambda k, d: int(tags.get(k) or d)
    if number("NumberOfFrames", 1) != 1 or number("SamplesPerPixel", 1) != 1:
        raise ValueError("not a single film")
    rows, columns, bits = number("Rows", 0), number("Columns", 0), number("BitsAllocated", 16)
    if bits not in (8, 16, 32) or not rows or not columns:
        raise ValueError(f"{rows} x {columns} pixels of {bits} bits are not read")
    if len(data) - at < rows * columns * bits // 8:
        raise Incomplete("the pixels are cut off")
    kind = np.dtype(f"<{'i' if number('PixelRepresentation', 0) else 'u'}{bits // 8}")
    return {"tags": tags, "meta": meta, "pixels": np.frombuffer(data, kind, rows * columns, at).reshape(rows, columns)}
