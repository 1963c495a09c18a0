"""Tables that are computed once for equal inputs.

A table is kept under a key of the function, the version of this package's code, the parameters, and the path, size and time of every file
that it was made of. Where the key is known, its table is read back and no job runs; a file that was changed, added or taken away, another
parameter or other code make another key. A table counts only once its marker, which is written last, names it; of two writers at a time the first one's
marker holds, so a lost driver leaves nothing behind that is ever read.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import re
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@cache
def code_version() -> str:
    """A digest of this package's source files."""
    root = Path(__file__).resolve().parent.parent
    digest = hashlib.sha256()
    for path in sorted(root.rglob("*.py")):
        digest.update(f"{path.relative_to(root)}\0".encode() + path.read_bytes())
    return digest.hexdigest()


class Memo:
    """A folder of tables by key; all drivers that share the folder share the tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """(path, bytes, time of change) of a file, or of all files below a folder."""
        fs, where = self._fs(path)
        if not fs.exists(where):
            raise FileNotFoundError(path)
        found, out = fs.listFiles(where, True), []
        while found.hasNext():
            one = found.next()
            out.append((one.getPath().toString(), int(one.getLen()), int(one.getModificationTime())))
        return sorted(out)

    def _plain(self, value):
        """A parameter as it enters a key; a table stands for its plan and its files."""
        if isinstance(value, DataFrame):
            files = sorted(value.inputFiles())
            if not files:
                raise ValueError("a table that is not read from files has no key; write it first")
            plan = re.sub(r"#\d+L?", "", value._jdf.queryExecution().analyzed().toString())
            return {"plan": plan, "files": [self.files(f) for f in files]}
        if isinstance(value, (list, tuple)):
            return [self._plain(v) for v in value]
        if isinstance(value, dict):
            return {str(k): self._plain(v) for k, v in value.items()}
        if hasattr(value, "tobytes"):
            return {"shape": list(value.shape), "kind": str(value.dtype), "bytes": hashlib.sha256(value.tobytes()).hexdigest()}
        if value is None or isinstance(value, (str, int, float, bool)):
            return value
        raise TypeError(f"{type(value).__name__} cannot be part of a key")

    def key(self, f: Callable[..., DataFrame], inputs: list[str], params: dict) -> str:
        defaults = {n: p.default for n, p in inspect.signature(f).parameters.items() if p.default is not inspect.Parameter.empty}
        about = {"function": f"{f.__module__}.{f.__qualname__}", "code": code_version(), "own": _source(f), "inputs": [self.files(p) for p in inputs], "params": self._plain(defaults | params)}
        return hashlib.sha256(json.dumps(about, sort_keys=True).encode()).hexdigest()

    def table(self, f: Callable[..., DataFrame], inputs: list[str], **params) -> DataFrame:
        """f(spark, *inputs, **params), computed where its key is new; inputs are paths of files or folders."""
        entry = f"{self.folder}/{self.key(f, inputs, params)}"
        fs, marker = self._fs(f"{entry}/made.json")
        if not fs.exists(marker):
            made = f(self.spark, *inputs, **params)
            own = f"{entry}/table-{uuid.uuid4().hex}"
            made.write.parquet(own)
            text = json.dumps({"table": own, "schema": made.schema.json()})
            try:
                out = fs.create(marker, False)
            except Exception as error:
                if not fs.exists(marker):
                    raise error
                self._delete(own)  # another driver was first
            else:
                out.write(bytearray(text.encode()))
                out.close()
        stream = fs.open(marker)
        try:
            about = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return self.spark.read.schema(StructType.fromJson(json.loads(about["schema"]))).parquet(about["table"])

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def forget(self) -> None:
        """Deletes all tables."""
        self._delete(self.folder)


def _source(f: Callable) -> str:
    """What tells a function outside of this package from another of its name."""
    try:
        return hashlib.sha256(inspect.getsource(f).encode()).hexdigest()
    except (OSError, TypeError):
        return ""
