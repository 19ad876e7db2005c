"""Films in archives: a Spark data source over tar files, compressed or not, and plain files.

    archives.films(spark, "/data/films", "archive", "member", "tags").where("tags['Modality'] = 'DX'")

Columns that are not asked for are not produced: without content, a film's header is read and its pixels are passed over.
An archive that ends too early gives its whole members and a row, with its error, for the one it ends in. Compressed
archives are a partition each, since they can only be read from the start; members of plain tars and single files are
dealt over partitions of about PART_BYTES.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import dicom

MEMBER = "archive string, member string, size long, complete boolean, tags map<string,string>, content binary, error string"
KINDS = dict(c.split(" ", 1) for c in MEMBER.split(", "))
PART_BYTES, HEAD = 64_000_000, 16_384
COMPRESSED, TARS = (".tar.gz", ".tgz", ".tar.xz", ".tar.bz2"), (".tar",)


@dataclass
class Part(InputPartition):
    """A whole compressed archive (no members), or members (name, offset, size) of a file; a single file is its own member."""

    path: str
    members: list[tuple[str, int, int]] | None = None

    def __post_init__(self) -> None:
        super().__init__(0)


def _listed(root: str) -> tuple[pyarrow.fs.FileSystem, list]:
    fs, path = pyarrow.fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    info = fs.get_file_info(path)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
    return fs, sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, root: str):
        self.names, self.root = schema.names, root
        if unknown := set(self.names) - set(KINDS):
            raise ValueError(f"no column {sorted(unknown)[0]!r} in a film archive")

    def partitions(self) -> list[Part]:
        fs, files = _listed(self.root)
        out, near, size = [], [], 0
        for f in files:
            if f.path.endswith(COMPRESSED):
                out.append(Part(f.path))
            elif f.path.endswith(TARS):
                own, total = [], 0
                with fs.open_input_file(f.path) as stream:
                    try:
                        with tarfile.open(fileobj=stream, mode="r:") as tar:
                            for m in tar:
                                if m.isfile():
                                    own.append((m.name, m.offset_data, m.size))
                                    total += m.size
                                    if total >= PART_BYTES:
                                        out.append(Part(f.path, own))
                                        own, total = [], 0
                    except (tarfile.ReadError, EOFError, OSError):
                        pass  # what lies behind the fault can't be found; the reader tells of the member that is cut off
                out.append(Part(f.path, own))
            else:
                near.append((f.path, 0, f.size))
                size += f.size
                if size >= PART_BYTES:
                    out.append(Part("", near))
                    near, size = [], 0
        return [*out, *([Part("", near)] if near else [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        if partition.members is None:
            yield from self._streamed(fs, partition.path)
            return
        for name, at, size in partition.members:
            path = partition.path or name
            with fs.open_input_file(path) as f:
                f.seek(at)
                yield self._row(path, name if partition.path else name.rsplit("/", 1)[-1], size, f)

    def _streamed(self, fs: pyarrow.fs.FileSystem, path: str) -> Iterator[tuple]:
        name = ""
        with fs.open_input_stream(path, compression=None) as raw:
            try:
                with tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for m in tar:
                        if m.isfile():
                            name = m.name
                            f = tar.extractfile(m)
                            row = self._row(path, name, m.size, f)
                            while f.read(1 << 20):  # a member is whole if its end is there
                                pass
                            yield row
                            name = ""
            except (tarfile.ReadError, EOFError, OSError, ValueError) as e:  # zlib and lzma raise what they like
                yield self._told(path, name, None, False, None, None, f"the archive is cut off or broken: {type(e).__name__}: {e}")
            except Exception as e:
                if type(e).__module__ not in ("zlib", "_lzma", "lzma"):
                    raise
                yield self._told(path, name, None, False, None, None, f"the archive is cut off or broken: {type(e).__name__}: {e}")

    def _row(self, path: str, name: str, size: int, f) -> tuple:
        """A member. Where its content isn't asked for, only its header is read (and decompression passes over the rest)."""
        whole = "content" in self.names
        data = f.read(size if whole else min(size, HEAD))
        tags, error, complete = None, None, len(data) == (size if whole else min(size, HEAD))
        if complete and ({"tags", "complete", "error"} & {*self.names}) and data[128:132] == b"DICM":
            while True:
                try:
                    tags, _, at, _ = dicom.header(data)
                    n = [int(tags.get(k) or d) for k, d in (("Rows", 0), ("Columns", 0), ("SamplesPerPixel", 1), ("NumberOfFrames", 1), ("BitsAllocated", 16))]
                    complete = at >= 0 and size - at >= n[0] * n[1] * n[2] * n[3] * n[4] // 8
                    error = None if complete else "the pixels are cut off" if at >= 0 else "no pixels"
                except dicom.Incomplete as e:
                    if len(data) < size:
                        more = f.read(min(size, 4 * len(data)) - len(data))
                        if more:
                            data += more
                            continue
                    complete, error = False, str(e)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                break
        elif not complete:
            error = "the member is cut off"
        return self._told(path, name, size, complete, tags, data if whole and complete else None, error)

    def _told(self, *values) -> tuple:
        row = dict(zip(KINDS, values))
        return tuple(row[c] for c in self.names)


class FilmArchives(DataSource):
    """Format film_archives: option path, a file or folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "film_archives"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options["path"])


def films(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Members of the archives and files under path: the columns named, else all."""
    spark.dataSource.register(FilmArchives)
    chosen = columns or tuple(KINDS)
    return spark.read.format("film_archives").schema(", ".join(f"{c} {KINDS.get(c, 'string')}" for c in chosen)).load(path)


def write(rows: DataFrame, root: str, member: str, content: str, compressed: bool = True) -> int:
    """Packs each partition of rows into a tar file under root, a folder that executors share; the number of members. A file shows up when it is whole, and a task that runs again replaces its own."""
    ending = ".tar.gz" if compressed else ".tar"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fs, path = pyarrow.fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        fs.create_dir(path, recursive=True)
        hidden, n = f"{path}/.{uuid.uuid4().hex}", 0
        with fs.open_output_stream(hidden) as out, tarfile.open(fileobj=out, mode="w|gz" if compressed else "w|") as tar:
            for b in batches:
                for name, data in zip(b["member"], b["content"]):
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                    n += 1
        fs.move(hidden, f"{path}/part-{TaskContext.get().partitionId():05d}{ending}")
        yield pd.DataFrame({"n": [n]})

    packed = rows.selectExpr(f"string(`{member}`) AS member", f"coalesce(cast(`{content}` AS binary), cast('' AS binary)) AS content").mapInPandas(run, "n long")
    return packed.agg({"n": "sum"}).first()[0] or 0
