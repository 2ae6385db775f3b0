"""Packed model-file header catalog.

Executors read only the header of each file (magic, version, typed
key/value fields, tensor infos), never tensor data. Two tables come out of
the same scan: ``kv`` (one row per field, in file order) and ``tensors``
(name, type, numpy-order shape, sizes, absolute data offset). A file whose
header is invalid yields one row carrying ``error``.
"""

from __future__ import annotations

import io
import json
import os
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tallyframe.operators.catalog import QUANT_TYPES
from tallyframe.sources.files import BinarySource, Names, file_listing, in_frames, rows_of

# File magic, readable versions, default data alignment.
MAGIC = b"GGUF"
SUPPORTED_VERSIONS = (2, 3)
DEFAULT_ALIGNMENT = 32
ALIGNMENT_KEY = "general.alignment"
# key/value type codes -> (name, struct format); 8 = string, 9 = array.
VALUE_TYPES = {0: ("UINT8", "B"), 1: ("INT8", "b"), 2: ("UINT16", "H"), 3: ("INT16", "h"),
               4: ("UINT32", "I"), 5: ("INT32", "i"), 6: ("FLOAT32", "f"), 7: ("BOOL", "?"),
               8: ("STRING", None), 9: ("ARRAY", None), 10: ("UINT64", "Q"), 11: ("INT64", "q"),
               12: ("FLOAT64", "d")}
TYPE_BY_CODE = {code: (name, bs, ts) for name, code, bs, ts in QUANT_TYPES}

KV_SCHEMA = "file string, pos int, key string, vtype string, is_array boolean, value string, error string"
TENSOR_SCHEMA = ("file string, pos int, name string, dtype string, shape array<bigint>, n_elements bigint, "
                 "n_bytes bigint, rel_offset bigint, data_offset bigint, error string")


class _Header:
    def __init__(self, fh):
        self.fh = fh
        self.order = "<"

    def take(self, fmt: str):
        fmt = self.order + fmt
        size = struct.calcsize(fmt)
        b = self.fh.read(size)
        if len(b) < size:
            raise ValueError("header ends early")
        return struct.unpack(fmt, b)

    def string(self) -> str:
        (n,) = self.take("Q")
        b = self.fh.read(n)
        if len(b) < n:
            raise ValueError("header ends early")
        return b.decode("utf-8", errors="replace")

    def value(self, vtype: int):
        if vtype == 8:
            return self.string()
        if vtype == 9:
            (etype,) = self.take("I")
            (count,) = self.take("Q")
            return [self.value(etype) for _ in range(count)], etype
        if vtype not in VALUE_TYPES:
            raise ValueError(f"unknown value type {vtype}")
        return self.take(VALUE_TYPES[vtype][1])[0]


    def open(self) -> tuple[int, int]:
        """Number of tensors and of key/value fields."""
        if self.fh.read(4) != MAGIC:
            raise ValueError("magic invalid")
        (version,) = self.take("I")
        if version & 0xFFFF == 0:          # written with the other byte order
            self.order = ">"
            version = struct.unpack(">I", struct.pack("<I", version))[0]
        if version not in SUPPORTED_VERSIONS:
            raise ValueError(f"unsupported version {version}")
        return self.take("QQ")

    def fields(self, n: int) -> Iterator[tuple]:
        """(pos, key as given, its column name, type code, type, value)."""
        seen: set = set()
        for i in range(n):
            start = self.fh.tell()
            key = self.string()
            (vtype,) = self.take("I")
            val = self.value(vtype)
            if vtype == 9:
                val, etype = val
                tname = f"ARRAY<{VALUE_TYPES.get(etype, ('?', None))[0]}>"
            else:
                tname = VALUE_TYPES[vtype][0]
            yield i, key, key if key not in seen else f"{key}_{start}", vtype, tname, val   # repeated key keeps both
            seen.add(key)

    def infos(self, n: int) -> Iterator[tuple]:
        """(pos, name, dims, type code, relative offset) of every tensor."""
        for i in range(n):
            name = self.string()
            (nd,) = self.take("I")
            *dims, code, off = self.take(f"{nd}QIQ")
            yield i, name, dims, code, off


def _repeated(path: str, hashes: set[int], n: int) -> str | None:
    """The first of ``n`` tensors whose name an earlier one has."""
    names: set = set()
    with BinarySource(path) as fh:
        h = _Header(fh)
        _, n_kv = h.open()
        for _ in h.fields(n_kv):
            pass
        for _, name, *_ in h.infos(n):
            if hash(name) in hashes:
                if name in names:
                    return name
                names.add(name)
    return None


def _check(path: str) -> int:
    """Read a whole header, holding eight bytes a tensor; the start of the
    data, or an error."""
    with BinarySource(path) as fh:
        h = _Header(fh)
        n_tensors, n_kv = h.open()
        alignment = DEFAULT_ALIGNMENT
        for _, key, _, vtype, _, val in h.fields(n_kv):
            if key == ALIGNMENT_KEY:
                if vtype != 4:
                    raise ValueError("bad type for general.alignment")
                alignment = int(val)
        names, failed = Names(), None
        try:
            for _, name, *_ in h.infos(n_tensors):
                names.add(name)
        except (ValueError, struct.error) as exc:
            failed = exc
        end = fh.tell()
    twice = names.candidates()
    repeated = _repeated(path, twice, len(names.hashes)) if twice else None
    if repeated is not None:
        raise ValueError(f"duplicated tensor {repeated}")
    if failed:
        raise failed
    return end + (alignment - end % alignment) % alignment


def _rows(path: str, table: str, data_start: int) -> Iterator[tuple]:
    """Rows of one table of a checked header, one at a time."""
    with BinarySource(path) as fh:
        h = _Header(fh)
        n_tensors, n_kv = h.open()
        for i, _, name, vtype, tname, val in h.fields(n_kv):
            if table == "kv":
                yield i, name, tname, vtype == 9, json.dumps(val)
        if table == "kv":
            return
        for i, name, dims, code, off in h.infos(n_tensors):
            dname, bs, ts = TYPE_BY_CODE.get(code, (f"TYPE_{code}", 1, 0))
            n_el = 1
            for d in dims:
                n_el *= d
            yield i, name, dname, dims[::-1], n_el, n_el * ts // bs, off, data_start + off


def parse_header(path: str):
    """Return (kv rows, tensor rows, error) for one file."""
    try:
        start = _check(path)
    except (ValueError, struct.error) as exc:
        return [], [], str(exc)
    return list(_rows(path, "kv", start)), list(_rows(path, "tensors", start)), None


def scan_packed_catalog(spark: SparkSession, root: str, table: str = "tensors", glob: str = "*.gguf") -> DataFrame:
    """``table='tensors'`` or ``'kv'`` rows from the header of every
    matching file under ``root``. Executors parse the headers in parallel
    over a metadata-only listing (no path list on the driver), first to check
    them and then for the rows, which are never held together."""
    schema = KV_SCHEMA if table == "kv" else TENSOR_SCHEMA
    cols = [f.split()[0] for f in schema.split(", ")]
    width = len(cols)

    def of_file(p: str) -> Iterator[tuple]:
        try:
            start = _check(p)
        except (ValueError, struct.error) as exc:
            yield (p,) + (None,) * (width - 2) + (str(exc),)
            return
        yield from ((p, *r, None) for r in _rows(p, table, start))

    def read(batches):
        yield from in_frames((r for pdf in batches for p in pdf["path"].tolist() for r in of_file(p)), cols)
    return file_listing(spark, root, glob).mapInPandas(read, schema)


# --------------------------------------------------------------- stand-ins
class _Writer:
    """Header parts of a stand-in file."""

    def __init__(self, out, order: str):
        self.out, self.order = out, order

    def put(self, fmt: str, *v) -> None:
        self.out.write(struct.pack(self.order + fmt, *v))

    def string(self, x: str) -> None:
        b = x.encode("utf-8")
        self.put("Q", len(b))
        self.out.write(b)

    def value(self, vtype: int, v) -> None:
        if vtype == 8:
            self.string(v)
        elif vtype == 9:
            etype, items = v
            self.put("I", etype)
            self.put("Q", len(items))
            for it in items:
                self.value(etype, it)
        else:
            self.put(VALUE_TYPES[vtype][1], v)

    def head(self, n_tensors: int, kvs) -> None:
        self.out.write(MAGIC)
        self.put("I", 3)
        self.put("QQ", n_tensors, len(kvs))
        for k, vtype, v in kvs:
            self.string(k)
            self.put("I", vtype)
            self.value(vtype, v)

    def info(self, name: str, dims, code: int, off: int) -> None:
        self.string(name)
        self.put(f"I{len(dims)}QIQ", len(dims), *dims, code, off)

    def pad(self, alignment: int) -> None:
        self.out.write(bytes(-self.out.tell() % alignment))


def _pack(order: str, kvs, tensors, alignment: int) -> bytes:
    """Header bytes for stand-in files (no tensor data is written)."""
    w = _Writer(io.BytesIO(), order)
    w.head(len(tensors), kvs)
    for t in tensors:
        w.info(*t)
    w.pad(alignment)
    return w.out.getvalue()


def _role(name: str) -> str:
    """Role word of a (possibly path-qualified) tensor name: the dotted part
    before the suffix, e.g. ``attn_q`` in ``blk.2.attn_q.weight``."""
    parts = name.rsplit("/", 1)[-1].split(".")
    return parts[-2] if len(parts) >= 2 else parts[0]


def _write_packed(batches: Iterable[pd.DataFrame], root: str, alignment: int) -> Iterator[tuple]:
    """Write rows that come by file and position. What stands before a file's
    tensors needs all of them, so they go to a spool on the task's disk first."""
    codes = {name: code for name, code, _, _ in QUANT_TYPES}
    for f, recs in groupby(rows_of(batches), key=attrgetter("file")):
        order = ">" if int(f.rsplit("-", 1)[-1]) % 2 else "<"
        off, n, roles = 0, 0, set()
        with tempfile.TemporaryFile() as spool:
            infos = _Writer(spool, order)
            for r in recs:
                infos.info(r.name, [int(d) for d in reversed(list(r.shape))], codes[r.dtype], off)
                off += (int(r.n_bytes) + alignment - 1) // alignment * alignment
                roles.add(_role(r.name))
                n += 1
            kvs = [("general.architecture", 8, "llama"), ("general.name", 8, f),
                   (ALIGNMENT_KEY, 4, alignment), ("split.tensors.count", 10, n),
                   ("general.roles", 9, (8, sorted(roles)))]
            spool.seek(0)
            with open(os.path.join(root, f"{f}.gguf"), "wb") as fh:
                w = _Writer(fh, order)
                w.head(n, kvs)
                shutil.copyfileobj(spool, fh)
                w.pad(alignment)
        yield (f, n)


def write_packed_headers(df: DataFrame, root: str, alignment: int = DEFAULT_ALIGNMENT) -> DataFrame:
    """Write header-only stand-in files from rows ``(file, pos, name, dtype,
    shape, n_bytes)``: tensors in ``pos`` order with aligned relative
    offsets, plus a few typed fields; rows are sorted by Spark and written one
    at a time. Returns ``(file, n_tensors)``."""
    os.makedirs(root, exist_ok=True)

    def write(batches):
        yield from in_frames(_write_packed(batches, root, alignment), ["file", "n_tensors"])
    return df.repartition("file").sortWithinPartitions("file", "pos").mapInPandas(write, "file string, n_tensors long")


__all__ = ["scan_packed_catalog", "write_packed_headers", "parse_header"]
