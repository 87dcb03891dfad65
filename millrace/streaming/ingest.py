"""The append log of a tenant: numbered entries that readers see at once, compacted into tables by a stream.

An entry is one JSON-lines file named by its number (LSN), created exclusively, so it is durable when ``append``
returns. A tail is the entries after the last compacted one. The compactor is a Structured Streaming query over the
log whose micro-batches are committed with their batch number in the manifest, so that a batch that is run
again after a failure isn't committed twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Catalog
from millrace.errors import CommitConflict
from millrace.sources import tables
from millrace.types import coerce


class Log:
    def __init__(self, catalog: Catalog, tenant: str, table: str):
        self.catalog, self.files, self.tenant, self.table = catalog, catalog.files, tenant, table
        self.dir = f"{catalog.root}/wal/{tenant}/{table}"
        self.spark = catalog.files.spark

    def numbers(self) -> list[int]:
        return sorted(int(p.rpartition("/")[2][:-5]) for p, _, folder in self.files.list(f"{self.dir}/entries") if not folder and p.endswith(".json"))

    def high_water(self) -> int:
        """The last number ever given; 0 for an empty log."""
        return max([0, *self.numbers(), self.truncated()])

    def truncated(self) -> int:
        marks = [int(p.rpartition("/")[2]) for p, _, _ in self.files.list(f"{self.dir}/truncated")]
        return max([0, *marks])

    def encode(self, rows: Iterable[dict]) -> list[str]:
        """Rows as lines of an entry; a row that doesn't fit the table is refused."""
        schema = self.catalog.load(self.tenant, self.table).struct()
        lines = []
        for row in rows:
            own = {f.name: coerce(row.get(f.name), f) for f in schema.fields}
            lines.append(json.dumps({k: bytes(v).hex() if isinstance(v, bytearray) else str(v) if hasattr(v, "isoformat") else v for k, v in own.items()}))
        return lines

    def append(self, rows: Iterable[dict]) -> int:
        """Writes rows as one entry and returns its number, one more than the last."""
        return self.append_lines(self.encode(rows))

    def append_lines(self, lines: list[str]) -> int:
        n = self.high_water() + 1
        while not self.files.create(f"{self.dir}/entries/{n:020d}.json", "\n".join(lines) + "\n"):
            n += 1
        return n

    def _read(self, source: DataFrame, schema: T.StructType) -> DataFrame:
        """Rows of raw lines with their entry's number."""
        lsn = F.regexp_extract("_metadata.file_name", r"(\d+)\.json", 1).cast("long")
        plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType) for f in schema.fields])
        parsed = source.select(lsn.alias("_lsn"), F.from_json("value", plain).alias("r"))
        return parsed.select("_lsn", *(F.unhex(f"r.{f.name}").alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"r.{f.name}").alias(f.name) for f in schema.fields))

    def read_from(self, after: int) -> DataFrame:
        """Entries after a number, with _lsn."""
        schema = self.catalog.load(self.tenant, self.table).struct()
        paths = [f"{self.dir}/entries/{n:020d}.json" for n in self.numbers() if n > after]
        if not paths:
            return self.spark.createDataFrame([], T.StructType([T.StructField("_lsn", T.LongType()), *schema.fields]))
        return self._read(self.spark.read.text(paths), schema)

    def scan(self) -> DataFrame:
        """The table's head and the tail of the log that isn't in it yet."""
        head = self.catalog.load(self.tenant, self.table)
        tail = self.read_from(head.batch or 0).drop("_lsn")
        return tables.read(self.spark, head).unionByName(tail)

    def compact(self) -> int:
        """Moves the tail into the table: one micro-batch stream run to the end of the log. Returns the last compacted number.

        The manifest holds the greatest number that is in the table: a batch that comes again adds nothing.
        """
        schema = self.catalog.load(self.tenant, self.table).struct()
        if not self.numbers():
            return self.catalog.load(self.tenant, self.table).batch or 0
        stream = self._read(self.spark.readStream.format("text").option("pathGlobFilter", "*.json").load(f"{self.dir}/entries"), schema)

        def commit(batch: DataFrame, _: int) -> None:
            for _attempt in range(5):
                head = self.catalog.load(self.tenant, self.table)
                new = batch.where(F.col("_lsn") > (head.batch or 0))
                last = new.agg(F.max("_lsn")).first()[0]
                if last is None:
                    return
                added = tables.write(new.drop("_lsn"), self.catalog.table_dir(self.tenant, self.table), self.files)
                try:
                    self.catalog.append(self.tenant, self.table, head.id, added, batch=last)
                    return
                except CommitConflict:
                    continue
            raise CommitConflict(f"{self.table} kept changing")

        stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{self.dir}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self.catalog.load(self.tenant, self.table).batch or 0

    def truncate(self) -> int:
        """Deletes the entries that are in the table; returns how many."""
        upto = self.catalog.load(self.tenant, self.table).batch or 0
        gone = [n for n in self.numbers() if n <= upto]
        if gone:
            self.files.create(f"{self.dir}/truncated/{max(gone):020d}", "")
        for n in gone:
            self.files.delete(f"{self.dir}/entries/{n:020d}.json")
        return len(gone)
