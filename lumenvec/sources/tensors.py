"""Tensor files: ``.npy``, ``.npz`` and the zipped ``.pt`` form, read without a tensor library.

A ``.pt`` file is a zip archive of a pickle and raw storages. Only tensors, numbers, strings, lists,
tuples and dictionaries are accepted from the pickle; nothing else in it is ever called. The values
are stored uncompressed, so tasks read ranges of rows through memory maps; the folder must be mounted
where they run.
"""

from __future__ import annotations

import io
import pickle
import struct
import zipfile
from collections import OrderedDict
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Storage classes of the format and their numpy types (fixed values).
STORAGES = {
    "FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "i1",
    "ByteStorage": "u1", "BoolStorage": "?",
}


@dataclass(frozen=True)
class Stored:
    """Where a contiguous tensor lies in a file."""

    path: str
    offset: int
    dtype: str
    shape: tuple[int, ...]

    def open(self) -> np.ndarray:
        if not np.prod(self.shape):
            return np.zeros(self.shape, self.dtype)
        return np.memmap(self.path, mode="r", dtype=self.dtype, offset=self.offset, shape=self.shape)


def _data_offset(path: str, entry: zipfile.ZipInfo) -> int:
    if entry.compress_type != zipfile.ZIP_STORED:
        raise ValueError(f"{path}: {entry.filename} is compressed")
    with open(path, "rb") as f:
        f.seek(entry.header_offset + 26)
        name, extra = struct.unpack("<HH", f.read(4))
    return entry.header_offset + 30 + name + extra


def _contiguous(shape: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(int(np.prod(shape[k + 1 :])) for k in range(len(shape)))


class _Unpickler(pickle.Unpickler):
    def __init__(self, path: str, archive: zipfile.ZipFile, root: str):
        super().__init__(io.BytesIO(archive.read(f"{root}/data.pkl")))
        self.path, self.archive, self.root = path, archive, root

    def persistent_load(self, pid):
        kind, storage, key, _, count = pid
        if kind != "storage":
            raise pickle.UnpicklingError(f"{self.path}: {kind}")
        return storage, self.archive.getinfo(f"{self.root}/data/{key}"), count

    def find_class(self, module: str, name: str):
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return self.tensor
        if module == "torch" and name in STORAGES:
            return STORAGES[name]
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        raise pickle.UnpicklingError(f"{self.path}: {module}.{name} is not part of a tensor file")

    def tensor(self, storage, offset, shape, stride, *_):
        dtype, entry, _ = storage
        if tuple(stride) != _contiguous(shape) and np.prod(shape) > 1:
            raise ValueError(f"{self.path}: a tensor is not contiguous")
        return Stored(self.path, _data_offset(self.path, entry) + offset * np.dtype(dtype).itemsize, dtype, tuple(shape))


def load(path: str) -> object:
    """What a tensor file holds: a ``Stored`` tensor, or a dictionary of such and of plain values."""
    suffix = Path(path).suffix.lower()
    if suffix == ".npy":
        x = np.load(path, mmap_mode="r")
        if not x.flags.c_contiguous:
            raise ValueError(f"{path}: not in row order")
        return Stored(path, x.offset, x.dtype.str, x.shape)
    with zipfile.ZipFile(path) as archive:
        if suffix == ".npz":
            found = {}
            for entry in archive.infolist():
                with archive.open(entry) as f:
                    version = np.lib.format.read_magic(f)
                    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                    shape, fortran, dtype = read(f)
                    if fortran:
                        raise ValueError(f"{path}: {entry.filename} is not in row order")
                    found[entry.filename.removesuffix(".npy")] = Stored(path, _data_offset(path, entry) + f.tell(), dtype.str, shape)
            return found
        root = next(n for n in archive.namelist() if n.endswith("/data.pkl")).rpartition("/")[0]
        return _Unpickler(path, archive, root).load()


def pick(loaded: object, key: str | None, path: str) -> Stored:
    """The tensor itself, or the one of this key."""
    if isinstance(loaded, dict):
        if key not in loaded:
            raise KeyError(f"{path} has no {key!r}; it has {sorted(map(str, loaded))}")
        loaded = loaded[key]
    if not isinstance(loaded, Stored):
        raise TypeError(f"{path}: {key!r} is no tensor")
    return loaded


def as_2d(tensor: Stored, name: str) -> Stored:
    """A matrix; one of shape (n, 1, d) is squeezed, all others are refused."""
    shape = tensor.shape
    if len(shape) == 3 and shape[1] == 1:
        shape = (shape[0], shape[2])
    if len(shape) != 2:
        raise ValueError(f"{name} must be a matrix, not of shape {shape}")
    return Stored(tensor.path, tensor.offset, tensor.dtype, shape)


@dataclass
class Rows(InputPartition):
    tensor: Stored
    start: int
    end: int

    def __post_init__(self):
        self.value = self.start


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.key, self.chunk = options["path"], options.get("key"), int(options.get("chunk_rows", 65536))

    def partitions(self) -> list[Rows]:
        tensor = as_2d(pick(load(self.path), self.key, self.path), self.key or self.path)
        return [Rows(tensor, s, min(s + self.chunk, tensor.shape[0])) for s in range(0, max(1, tensor.shape[0]), self.chunk)]

    def read(self, partition: Rows):
        x = np.asarray(partition.tensor.open()[partition.start : partition.end], np.float32)
        offsets = np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)
        if len(x):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(partition.start, partition.start + len(x))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))], ["id", "vec"]
            )


class TensorSource(DataSource):
    """``spark.read.format("tensor_file").option("key", ...).load(path)``: ``id, vec``."""

    @classmethod
    def name(cls) -> str:
        return "tensor_file"

    def schema(self) -> str:
        return "id long, vec array<float>"

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options)


def read_tensor(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """``id, vec`` of a matrix in a tensor file; raises here if there is none of this key."""
    as_2d(pick(load(path), key, path), key or path)
    spark.dataSource.register(TensorSource)
    reader = spark.read.format("tensor_file")
    return (reader.option("key", key) if key else reader).load(path)


def read_pair(
    spark: SparkSession, path: str | None = None, vision_path: str | None = None, text_path: str | None = None, vision_key: str = "vision_feats", text_key: str = "text_feats"
) -> tuple[DataFrame, DataFrame]:
    """Both sides, from one file with two keys or from two files (each a bare tensor or one with its key)."""
    if path is None and (vision_path is None or text_path is None):
        raise ValueError("give one file, or one for each side")
    return read_tensor(spark, path or vision_path, vision_key), read_tensor(spark, path or text_path, text_key)


def read_training(spark: SparkSession, folder: str, train: str, validation: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Training and validation sides from two files of a folder, each with both keys."""
    return (*read_pair(spark, f"{folder}/{train}"), *read_pair(spark, f"{folder}/{validation}"))


class _Names:
    """Writes the pickle of a tensor file by its opcodes: values, and references to classes that need not exist here."""

    def __init__(self):
        self.out, self.storages = bytearray(pickle.PROTO + b"\x02"), []

    def text(self, value: str) -> None:
        data = value.encode()
        self.out += pickle.BINUNICODE + struct.pack("<I", len(data)) + data

    def named(self, module: str, name: str) -> None:
        self.out += pickle.GLOBAL + f"{module}\n{name}\n".encode()

    def integer(self, value: int) -> None:
        data = pickle.encode_long(int(value))
        self.out += pickle.LONG1 + bytes([len(data)]) + data

    def sequence(self, values, close: bytes) -> None:
        self.out += pickle.MARK
        for v in values:
            self.value(v)
        self.out += close

    def tensor(self, x: np.ndarray) -> None:
        kind = next(k for k, d in STORAGES.items() if np.dtype(d) == x.dtype)
        self.named("torch._utils", "_rebuild_tensor_v2")
        self.out += pickle.MARK + pickle.MARK
        self.text("storage")
        self.named("torch", kind)
        self.text(str(len(self.storages)))
        self.text("cpu")
        self.integer(x.size)
        self.out += pickle.TUPLE + pickle.BINPERSID
        self.integer(0)
        self.sequence(x.shape, pickle.TUPLE)
        self.sequence(_contiguous(x.shape), pickle.TUPLE)
        self.out += pickle.NEWFALSE
        self.named("collections", "OrderedDict")
        self.out += pickle.EMPTY_TUPLE + pickle.REDUCE + pickle.TUPLE + pickle.REDUCE
        self.storages.append(np.ascontiguousarray(x).tobytes())

    def value(self, v) -> None:
        if isinstance(v, np.ndarray):
            self.tensor(v)
        elif isinstance(v, dict):
            self.out += pickle.EMPTY_DICT
            self.sequence([x for item in v.items() for x in item], pickle.SETITEMS)
        elif isinstance(v, list | tuple):
            self.out += pickle.EMPTY_LIST
            self.sequence(v, pickle.APPENDS)
        elif v is None or isinstance(v, bool):
            self.out += {None: pickle.NONE, True: pickle.NEWTRUE, False: pickle.NEWFALSE}[v]
        elif isinstance(v, float):
            self.out += pickle.BINFLOAT + struct.pack(">d", v)
        elif isinstance(v, int | np.integer):
            self.integer(v)
        else:
            self.text(str(v))


def save(value: object, path: str) -> None:
    """A tensor, or a dictionary of tensors and plain values, as ``.pt``; the whole file or none."""
    from lumenvec.sources.files import replaced

    names = _Names()
    names.value(value)
    names.out += pickle.STOP
    with replaced(path, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("archive/data.pkl", bytes(names.out))
        archive.writestr("archive/byteorder", "little")
        for k, data in enumerate(names.storages):
            archive.writestr(f"archive/data/{k}", data)
        archive.writestr("archive/version", "3\n")
