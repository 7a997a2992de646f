"""Exports of several tables that are there as a whole or not at all.

Every table of an export is written below a fresh name. When all are there, one small manifest that names them is put into
place by a rename. Readers follow the newest manifest and nothing else, so a run that stops between two tables leaves an
export that isn't there, or the whole one of the run before; a run that is repeated replaces it as a whole."""

from __future__ import annotations

import json
import time
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest-"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_export(tables: dict[str, tuple[DataFrame, str]], path: str) -> None:
    """Writes tables given as name: (table, format) below ``path``, then the manifest."""
    named = {}
    for name, (table, kind) in tables.items():
        folder = f"{name}-{uuid.uuid4().hex}"
        table.write.format(kind).save(f"{path}/{folder}")
        named[name] = {"folder": folder, "format": kind, "schema": table.schema.json()}
    system, place = _place(path)
    # Later manifests sort behind earlier ones; a name is never used twice, so nothing is overwritten.
    last = f"{MANIFEST}{time.time_ns():020d}-{uuid.uuid4().hex}.json"
    system.create_dir(place)
    with system.open_output_stream(f"{place}/.{last}") as out:
        out.write(json.dumps(named).encode())
    system.move(f"{place}/.{last}", f"{place}/{last}")


def manifest(path: str) -> dict | None:
    """The tables of the newest whole export; null if there is none."""
    system, place = _place(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return None
    found = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.base_name.startswith(MANIFEST))
    if not found:
        return None
    with system.open_input_stream(f"{place}/{found[-1]}") as data:
        return json.loads(data.read())


def read_export(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of the newest whole export."""
    from pyspark.sql.types import StructType
    tables = manifest(path)
    if tables is None or name not in tables:
        raise FileNotFoundError(f"{path} holds no whole export with a table {name!r}")
    about = tables[name]
    return spark.read.schema(StructType.fromJson(json.loads(about["schema"]))).format(about["format"]).load(f"{path}/{about['folder']}")


def drop_replaced(path: str) -> int:
    """Removes what the newest manifest doesn't name: older exports and the rests of stopped runs. The number of folders removed.

    Not while another run may be writing to the same place."""
    tables = manifest(path)
    if tables is None:
        return 0
    system, place = _place(path)
    kept = {about["folder"] for about in tables.values()}
    entries = system.get_file_info(fs.FileSelector(place))
    newest = max(e.base_name for e in entries if e.base_name.startswith(MANIFEST))
    old = [e for e in entries if e.type == fs.FileType.Directory and e.base_name not in kept]
    for entry in old:
        system.delete_dir(entry.path)
    for entry in entries:
        if entry.type == fs.FileType.File and entry.base_name.lstrip(".").startswith(MANIFEST) and entry.base_name != newest:
            system.delete_file(entry.path)
    return len(old)
