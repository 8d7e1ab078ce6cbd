"""Records of a remote log, pulled page by page: a data source whose offsets are cursors.

A remote keeps the records of its zones in their order. The offset of a stream over it is the
last sequence pulled of each zone, so a query that starts again goes on behind what it has
committed, and no record comes twice or is passed over.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Records of a page, and sequences of a zone that one task pulls and that are read at once.
PAGE, SPAN = 200, 1 << 16
SCHEMA = "zone string, zone_sequence long, record_id string, record_kind string, body string"
COLUMNS = ["zone", "zone_sequence", "record_id", "record_kind", "body"]


def dataset_of(source: str | list[str]):
    from pyarrow import dataset

    return dataset.dataset(source, format="parquet")


class Remote:
    """What a remote answers, over Parquet files of its records.

    Any transport that gives a zone's next records behind a cursor can stand in for it. A page is
    cut from a block of sequences that is kept until it is used up, so records are read once and
    not once a page. ``files`` and ``tops`` (the last sequence of a zone that is of interest)
    bound what is looked at; without them it is all.
    """

    def __init__(self, path: str, files: list[str] | None = None, tops: dict[str | None, int] | None = None):
        self.path, self.files, self.tops = path, files, tops
        self._dataset, self._block = None, ((), 0, 0, [], [])

    def _data(self):
        if self._dataset is None:
            self._dataset = dataset_of(self.files or self.path.removeprefix("file://"))
        return self._dataset

    def extents(self) -> list[tuple[str, str | None, int, int]]:
        """(file, zone, first and last sequence), from the footers where a row group is of one
        zone; row groups of several zones are read, one at a time."""
        found: dict[tuple, tuple[int, int]] = {}
        for piece in self._data().get_fragments():
            for group in piece.split_by_row_group():
                meta = piece.metadata.row_group(group.row_groups[0].id)
                stats = {meta.column(j).path_in_schema: meta.column(j).statistics for j in range(meta.num_columns)}
                zone, at = stats.get("zone"), stats.get("zone_sequence")
                if zone and at and zone.has_min_max and at.has_min_max and zone.null_count == 0 and zone.min == zone.max:
                    spans = [(zone.min, at.min, at.max)]
                else:
                    sums = group.to_table(columns=["zone", "zone_sequence"], use_threads=False).group_by("zone").aggregate([("zone_sequence", "min"), ("zone_sequence", "max")])
                    spans = [(r["zone"], r["zone_sequence_min"], r["zone_sequence_max"]) for r in sums.to_pylist()]
                for name, low, high in spans:
                    if low is not None:
                        was = found.get((piece.path, name), (low, high))
                        found[piece.path, name] = min(low, was[0]), max(high, was[1])
        return [(path, name, low, high) for (path, name), (low, high) in found.items()]

    def ends(self) -> dict[str | None, int]:
        """The last sequence of each zone."""
        return last_of(self.extents())

    def _load(self, zone: str | None, after: int, limit: int) -> None:
        from pyarrow import compute as pc

        named = pc.field("zone").is_null() if zone is None else pc.field("zone") == zone
        # sequences are dense, so a range of numbers holds a page; a range with gaps is widened
        span = max(SPAN, limit + 1)
        while True:
            wanted = named & (pc.field("zone_sequence") > after) & (pc.field("zone_sequence") <= min(after + span, self.top(zone)))
            table = self._data().to_table(columns=COLUMNS, filter=wanted, use_threads=False)
            if table.num_rows > limit or after + span >= self.top(zone):
                break
            span *= 2
        table = table.sort_by([(c, "ascending") for c in ("zone_sequence", "record_kind", "record_id")])
        values = [table.column(c).to_pylist() for c in COLUMNS]
        self._block = (zone,), after, after + span, values[1], list(zip(*values, strict=True))

    def page(self, zone: str | None, after: int, limit: int) -> tuple[list[tuple], bool]:
        """The next ``limit`` records behind ``after``, and whether there are more."""
        name, low, high, marks, rows = self._block
        if name != (zone,) or after < low or (high < self.top(zone) and len(rows) - bisect_right(marks, after) <= limit):
            self._load(zone, after, limit)
            name, low, high, marks, rows = self._block
        at = bisect_right(marks, after)
        return rows[at : at + limit], len(rows) - at > limit

    def top(self, zone: str | None) -> int:
        if self.tops is None:
            self.tops = self.ends()
        return self.tops.get(zone, 0)


class ZoneRange(InputPartition):
    def __init__(self, zone: str | None, after: int, upto: int, files: list[str] | None = None):
        self.zone, self.after, self.upto, self.files = zone, after, upto, files


def last_of(extents: list[tuple]) -> dict[str | None, int]:
    last: dict[str | None, int] = {}
    for _, zone, _, high in extents:
        last[zone] = max(high, last.get(zone, 0))
    return last


def ranges(extents: list[tuple], start: dict, end: dict) -> list[ZoneRange]:
    """What lies between two offsets, SPAN sequences a task, each with the files that hold them;
    a range that no file has is left out, however wide a gap is."""
    out = []
    for zone in sorted(end, key=lambda z: (z is not None, z)):
        first, own, wanted = start.get(zone, 0), [e for e in extents if e[1] == zone], {}
        for path, _, low, high in own:
            for turn in range(max(low - 1 - first, 0) // SPAN, (min(high, end[zone]) - 1 - first) // SPAN + 1):
                wanted.setdefault(turn, []).append(path)
        out += [ZoneRange(zone, first + turn * SPAN, min(first + (turn + 1) * SPAN, end[zone]), sorted(files)) for turn, files in sorted(wanted.items())]
    return out


def read_range(remote: Remote, part: ZoneRange, limit: int):
    """All records of a zone in (after, upto], a page at a time.

    Records that share a sequence may lie on both sides of a page's end, so a page that is not
    the last is cut back to whole sequences, unless one sequence fills it.
    """
    after = part.after
    while after < part.upto:
        size = limit
        rows, more = remote.page(part.zone, after, size)
        while more and rows[0][1] == rows[-1][1]:
            size *= 2
            rows, more = remote.page(part.zone, after, size)
        if more:
            rows = [r for r in rows if r[1] < rows[-1][1]]
        for row in rows:
            if row[1] <= part.upto:
                yield row
        if not more:
            return
        after = rows[-1][1]


def remote_of(path: str, part: ZoneRange) -> Remote:
    return Remote(path, part.files, {part.zone: part.upto})


class PulledReader(DataSourceReader):
    def __init__(self, options: dict):
        self.remote, self.limit = Remote(options["path"]), int(options.get("limit", PAGE))
        self.cursors = json.loads(options.get("cursors", "{}"))

    def partitions(self):
        extents = self.remote.extents()
        return ranges(extents, self.cursors, last_of(extents))

    def read(self, part: ZoneRange):
        return read_range(remote_of(self.remote.path, part), part, self.limit)


class PulledStream(DataSourceStreamReader):
    """Offsets are {zone: cursor}; a partition is a zone's range between two of them."""

    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("limit", PAGE))
        self.first = json.loads(options.get("cursors", "{}"))

    def initialOffset(self) -> dict:
        return self.first

    def latestOffset(self) -> dict:
        return {z: top for z, top in Remote(self.path).ends().items() if z is not None}  # offsets are JSON, whose keys are names

    def partitions(self, start: dict, end: dict):
        return ranges(Remote(self.path).extents(), start, end)

    def read(self, part: ZoneRange):
        return read_range(remote_of(self.path, part), part, self.limit)

    def commit(self, end: dict) -> None:
        pass


class PulledSource(DataSource):
    """``format("pulled")`` with ``path``, ``limit`` (records of a page) and ``cursors`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "pulled"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PulledReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PulledStream(self.options)


def pull(spark: SparkSession, path: str, cursors: dict[str, int] | None = None, limit: int = PAGE) -> DataFrame:
    """All records behind the cursors."""
    spark.dataSource.register(PulledSource)
    return spark.read.format("pulled").option("path", path).option("limit", str(limit)).option("cursors", json.dumps(cursors or {})).load()


def pull_stream(spark: SparkSession, path: str, limit: int = PAGE) -> DataFrame:
    spark.dataSource.register(PulledSource)
    return spark.readStream.format("pulled").option("path", path).option("limit", str(limit)).load()
