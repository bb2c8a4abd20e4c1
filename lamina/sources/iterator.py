"""Any cursor as a Spark source: a subclass of CursorSource says how many parts there are and yields a part's entries."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Entry = tuple[bytes, int, int, bytes | None]


class CursorSource(DataSource):
    """Entries (k, seq, type, v) of parts that are read apart, each in the order of keys."""

    @classmethod
    def name(cls) -> str:
        return "lamina_cursor"

    def schema(self) -> str:
        return "k binary, seq long, type int, v binary"

    def parts(self) -> int:
        raise NotImplementedError

    def entries(self, part: int) -> Iterator[Entry]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return CursorReader(self)


class CursorReader(DataSourceReader):
    def __init__(self, source: CursorSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.source.parts())]

    def read(self, partition: InputPartition) -> Iterator[Entry]:
        yield from self.source.entries(partition.value)


class SyntheticSource(CursorSource):
    """Puts of keys key_<i>, with values that depend on the key alone. Options: rows, parts, value_size."""

    @classmethod
    def name(cls) -> str:
        return "lamina_synthetic"

    def parts(self) -> int:
        return int(self.options.get("parts", "8"))

    def entries(self, part: int) -> Iterator[Entry]:
        rows, size = int(self.options.get("rows", "1000")), int(self.options.get("value_size", "100"))
        for i in range(part * rows // self.parts(), (part + 1) * rows // self.parts()):
            value = "".join(hashlib.sha256(f"{j}:{i}".encode()).hexdigest() for j in range(-(-size // 64)))
            yield b"key_%d" % i, i + 1, 1, value[:size].encode()
