"""DICOM bytes and archives: whole members, cut-off ones, headers without pixels."""

import io
import os
import struct
import tarfile

import numpy as np
import pytest

from tessella.sources import archives, corpus, dicom

NUMBERS = {name: tag for tag, name in dicom.KEYWORDS.items()}
META = {"TransferSyntaxUID", "SourceApplicationEntityTitle"}


def film(pixels, explicit=True, syntax=None, sequence=True, **tags):
    """A DICOM file of an array, by hand."""
    rows, columns = pixels.shape[-2:]
    tags = {"Modality": "DX", "PatientName": "DOE^JANE", "SamplesPerPixel": 1, "PhotometricInterpretation": "MONOCHROME2", "Rows": rows, "Columns": columns, "BitsAllocated": pixels.itemsize * 8, "PixelRepresentation": 0} | tags
    meta = {"TransferSyntaxUID": syntax or (dicom.EXPLICIT if explicit else dicom.IMPLICIT), "SourceApplicationEntityTitle": "WARD7"}

    def element(tag, value, plain):
        kind = b"US" if isinstance(value, int) else b"LO"
        raw = struct.pack("<H", value) if isinstance(value, int) else value.encode() + b" " * (len(value.encode()) % 2)
        head = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
        return head + (kind + struct.pack("<H", len(raw)) if plain else struct.pack("<I", len(raw))) + raw

    out = b"\0" * 128 + b"DICM" + b"".join(element(NUMBERS[k], v, True) for k, v in sorted(meta.items(), key=lambda x: NUMBERS[x[0]]))
    body = {NUMBERS[k]: element(NUMBERS[k], v, explicit) for k, v in tags.items()}
    if sequence:  # of unknown length, with an item of unknown length in it
        inner = element(0x00080104, "x", explicit)
        open_ = struct.pack("<HH", 0x0008, 0x1032) + (b"SQ\0\0" if explicit else b"") + struct.pack("<I", dicom.UNKNOWN)
        body[0x00081032] = open_ + struct.pack("<HHI", 0xFFFE, 0xE000, dicom.UNKNOWN) + inner + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    out += b"".join(v for _, v in sorted(body.items()))
    return out + struct.pack("<HH", 0x7FE0, 0x0010) + (b"OW\0\0" if explicit else b"") + struct.pack("<I", pixels.nbytes) + pixels.tobytes()


X = np.arange(40 * 30, dtype="<u2").reshape(40, 30)


@pytest.mark.parametrize("explicit", [True, False])
@pytest.mark.parametrize("kind", ["<u2", "|u1", "<i2"])
def test_dicom_bytes(explicit, kind):
    x = X.astype(kind)
    data = film(x, explicit, PixelRepresentation=int(kind == "<i2"), WindowCenter="10\\20")
    got = dicom.read("a.dcm", data)
    assert (got["pixels"] == x).all() and got["tags"]["PatientName"] == "DOE^JANE" and got["tags"]["Rows"] == "40" and got["tags"]["WindowCenter"] == "10\\20" and got["meta"]["SourceApplicationEntityTitle"] == "WARD7"
    for n in (100, 140, 200, len(data) - 1):
        with pytest.raises(ValueError):
            dicom.read("a.dcm", data[:n])
    for bad in (film(x, NumberOfFrames="2"), film(x, SamplesPerPixel=3), film(x, syntax="1.2.840.10008.1.2.4.50"), film(x, BitsAllocated=12), film(x, Rows=0)):
        with pytest.raises(ValueError):
            dicom.read("a.dcm", bad)


def packed(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    noise = np.random.default_rng(1).integers(0, 60_000, (300, 200)).astype("<u2")
    films = [(f"s/{k}.dcm", film(noise + k)) for k in range(4)]
    (tmp_path / "a.tar.gz").write_bytes(packed([*films, ("s/note.txt", b"hello"), ("s/frames.dcm", film(np.stack([X, X]), NumberOfFrames="2"))]))
    whole = packed(films)
    (tmp_path / "cut.tgz").write_bytes(whole[: len(whole) * 5 // 8])
    (tmp_path / "plain.tar").write_bytes(packed([("p.dcm", film(noise)), ("short.dcm", film(noise)[:-9]), ("q.dcm", film(X, explicit=False))], "w"))
    (tmp_path / "bad.tar.gz").write_bytes(b"no archive")
    (tmp_path / "one.dcm").write_bytes(film(X))
    return tmp_path


def test_archives_give_whole_members_and_say_what_is_cut_off(spark, folder):
    rows = {(r["archive"].rsplit("/", 1)[-1], r["member"]): r for r in archives.films(spark, str(folder)).collect()}
    assert {k for k, r in rows.items() if r["complete"]} == {*(("a.tar.gz", f"s/{k}.dcm") for k in range(4)), ("a.tar.gz", "s/note.txt"), ("a.tar.gz", "s/frames.dcm"), ("cut.tgz", "s/0.dcm"), ("cut.tgz", "s/1.dcm"), ("plain.tar", "p.dcm"), ("plain.tar", "q.dcm"), ("one.dcm", "one.dcm")}
    assert rows["cut.tgz", "s/2.dcm"]["error"].startswith("the archive is cut off") and rows["bad.tar.gz", ""]["error"] and rows["plain.tar", "short.dcm"]["error"] == "the pixels are cut off"
    assert rows["a.tar.gz", "s/note.txt"]["content"] == b"hello" and rows["a.tar.gz", "s/0.dcm"]["tags"]["Modality"] == "DX" and rows["plain.tar", "short.dcm"]["content"] is None


def test_headers_are_read_without_pixels(spark, folder):
    df = archives.films(spark, str(folder), "member", "tags", "complete")
    assert df.columns == ["member", "tags", "complete"]
    rows = [r for r in df.where("tags['PatientName'] IS NOT NULL").collect() if r["complete"]]
    assert len(rows) == 10 and all(r["tags"]["Modality"] == "DX" for r in rows)
    read = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    from pyspark.sql.types import StructType

    reader = archives._Reader(StructType.fromDDL("member string, tags map<string,string>"), str(folder))
    data = film(np.zeros((3_000, 3_000), "<u2"), sequence=False)
    assert reader._row("x", "x.dcm", len(data), Counting(data))[1]["Rows"] == "3000" and sum(read) <= archives.HEAD
    with pytest.raises(Exception):
        archives.films(spark, str(folder), "colour").collect()


def test_films_of_archives_are_scrubbed(spark, folder):
    films, cut = corpus.archived_films(spark, str(folder))
    rows = {r["path"].split(str(folder) + "/")[1]: r for r in films.collect()}
    assert len(rows) == 10 - 0 and rows["plain.tar/q.dcm"]["error"] is None and rows["plain.tar/q.dcm"]["width"] == 30 and rows["a.tar.gz/s/frames.dcm"]["error"].startswith("ValueError: not a single film")
    assert "PatientName" not in rows["one.dcm/one.dcm"]["tags"] and "PatientName" in rows["one.dcm/one.dcm"]["dropped"] and rows["one.dcm/one.dcm"]["dropped_meta"] == ["SourceApplicationEntityTitle"]
    assert {r["member"] for r in cut.collect()} == {"s/2.dcm", "short.dcm", ""}


@pytest.mark.parametrize("compressed", [True, False])
def test_written_archives_come_back(spark, tmp_path, compressed):
    rows = spark.range(50).selectExpr("concat('m', id) AS name", "repeat(string(id), int(id) * 40) AS body").repartition(3)
    assert archives.write(rows, str(tmp_path / "out"), "name", "body", compressed) == 50
    got = {r["member"]: bytes(r["content"]).decode() for r in archives.films(spark, str(tmp_path / "out"), "member", "content").collect()}
    assert got == {f"m{k}": str(k) * (k * 40) for k in range(50)} and len(os.listdir(tmp_path / "out")) == 3
