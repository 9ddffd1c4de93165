"""Numbered commits on shared storage: one small JSON file each, put only if its number is free.

A log is a folder ``<root>/<name>`` of files ``<number>.json``. A commit is written aside under
a hidden name and then given its number in one step that fails where the number exists: a
hard link on local disks, a rename without overwrite elsewhere. So a commit is there whole or
not at all, and two writers never share a number. All logs below a root are read by one scan.
"""
from __future__ import annotations

import json
import os
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

DIGITS = 12


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self, name: str) -> list[int]:
        """Numbers of a log's commits, ascending."""
        folder = self._path(name)
        fs = self._fs(folder)
        if not fs.exists(folder):
            return []
        files = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(f.removesuffix(".json")) for f in files if f.endswith(".json") and f.removesuffix(".json").isdigit())

    def put(self, name: str, number: int, entry: dict[str, Any]) -> bool:
        """Commit ``entry`` under ``number``; False where the number is taken."""
        text = json.dumps({**entry, "log": name, "number": number}, ensure_ascii=False) + "\n"
        folder, target = self._path(name), self._path(name, f"{number:0{DIGITS}d}.json")
        aside = self._path(name, f".{uuid.uuid4().hex}")
        fs = self._fs(folder)
        fs.mkdirs(folder)
        if fs.getScheme() == "file":
            here, there = aside.toUri().getPath(), target.toUri().getPath()
            with open(here, "w", encoding="utf-8") as file:
                file.write(text)
                file.flush()
                os.fsync(file.fileno())
            try:
                os.link(here, there)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(here)
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
        options[0] = getattr(files.Options.Rename, "NONE")
        try:
            files.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, options)
            return True
        except Py4JJavaError as error:
            fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise

    def append(self, name: str, entry: dict[str, Any]) -> int:
        """Commit ``entry`` under the next free number, which is returned."""
        number = (self.numbers(name) or [-1])[-1] + 1
        while not self.put(name, number, entry):
            number += 1
        return number

    def read(self, schema: str, name: str | None = None) -> DataFrame | None:
        """The commits of one log or of all, one row each (columns of ``schema``); None where there is none.

        A file that cannot be read as JSON gives a row of NULLs.
        """
        folder = self._path(*([name] if name else []))
        fs = self._fs(folder)
        if not fs.exists(folder) or not fs.listStatus(folder):
            return None
        return self.spark.read.schema(schema).json(folder.toString() if name else f"{folder.toString()}/*")

    def drop(self, name: str) -> bool:
        folder = self._path(name)
        fs = self._fs(folder)
        return fs.delete(folder, True) if fs.exists(folder) else False
