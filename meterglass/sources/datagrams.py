"""UDP datagrams as a stream: a Python data source whose offsets are numbered segments of a spool.

    spark.dataSource.register(DatagramSource)
    spark.readStream.format("datagrams").options(port=1700, spool="/data/spool").load()   # value binary, segment long, place long

The query's source process on the driver binds the socket; what arrives is appended to a segment each time Spark asks for the
latest offset, and synced before the offset is told, so a batch that was planned and not committed is read again from the
same segments after a restart, with the same rows. Committed segments are deleted. Rows travel to executors inside the
partitions, LIMIT datagrams each, so executors need no access to the spool; it must outlive the driver (a disk that the next
driver mounts too). Datagrams that arrive while no query runs are lost, as with any UDP receiver.
"""

from __future__ import annotations

import os
import socket
import threading
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

LIMIT, SEGMENTS, SIZE = 4096, 16, 65535
SCHEMA = "value binary, segment long, place long"


class Segment(InputPartition):
    def __init__(self, number: int, rows: list[bytes]):
        self.number, self.rows = number, rows


class Spool:
    """Numbered segments of length-prefixed datagrams in a folder; the last one is kept, so numbers never start again."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def numbers(self) -> list[int]:
        return sorted(int(p.stem) for p in self.folder.glob("*.seg"))

    def append(self, rows: list[bytes]) -> int:
        number = max(self.numbers(), default=-1) + 1
        draft = self.folder / f".{number:012d}"
        with draft.open("wb") as f:
            f.writelines(len(r).to_bytes(4, "big") + r for r in rows)
            f.flush()
            os.fsync(f.fileno())
        draft.rename(self.folder / f"{number:012d}.seg")
        return number

    def read(self, number: int) -> list[bytes]:
        raw, at, rows = (self.folder / f"{number:012d}.seg").read_bytes(), 0, []
        while at < len(raw):
            n = int.from_bytes(raw[at : at + 4], "big")
            rows.append(raw[at + 4 : at + 4 + n])
            at += 4 + n
        return rows

    def drop(self, below: int) -> None:
        for number in self.numbers()[:-1]:
            if number < below:
                (self.folder / f"{number:012d}.seg").unlink(missing_ok=True)


class DatagramReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port = options.get("host", "0.0.0.0"), int(options["port"])
        self.spool = Spool(options["spool"])
        self.limit = int(options.get("limit", LIMIT))
        self.told: int | None = None
        self.socket: socket.socket | None = None
        self.arrived: list[bytes] = []

    def __getstate__(self) -> dict:
        """What executors need to read partitions: not the socket."""
        return {"host": self.host, "port": self.port, "limit": self.limit}

    def listen(self) -> None:
        if self.socket is None:
            self.lock = threading.Lock()
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.socket.bind((self.host, self.port))
            threading.Thread(target=self.receive, daemon=True).start()

    def receive(self) -> None:
        while True:
            try:
                data, _ = self.socket.recvfrom(SIZE)
            except OSError:  # closed
                return
            if data:
                with self.lock:
                    self.arrived.append(data)

    def initialOffset(self) -> dict:
        self.listen()
        return {"segment": min(self.spool.numbers(), default=0)}

    def latestOffset(self) -> dict:
        """What has arrived goes to the spool; at most SEGMENTS more segments than were told before."""
        self.listen()
        with self.lock:
            rows, self.arrived = self.arrived, []
        for i in range(0, len(rows), self.limit):
            self.spool.append(rows[i : i + self.limit])
        end = max(self.spool.numbers(), default=-1) + 1
        if self.told is not None:
            end = min(end, self.told + SEGMENTS)
        self.told = end
        return {"segment": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Segment(n, self.spool.read(n)) for n in range(start["segment"], end["segment"]) if n in set(self.spool.numbers())]

    def read(self, partition: Segment) -> Iterator[tuple]:
        for i, row in enumerate(partition.rows):
            yield row, partition.number, i

    def commit(self, end: dict) -> None:
        self.spool.drop(end["segment"])

    def stop(self) -> None:
        if self.socket is not None:
            self.socket.close()


class DatagramSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return DatagramReader(self.options)
