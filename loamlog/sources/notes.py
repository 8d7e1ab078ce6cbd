"""Notes as files: one file a record, brought up to a table and no further.

The snapshot names a table of (path, digest) of what lies in the folder. A run compares digests,
writes what differs under names of its own (first phase), commits the new table with the moves
that are due, and then moves the files into place and removes what went (second phase). A run
that is lost in between is finished by the next; files that did not change are not touched.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.sources.store import Store

TABLE, MOVES = "path string, digest string", "path string, draft string"
#: Relative paths of plain names alone; nothing may lead out of the folder.
PATH = r"^(?!\.)[A-Za-z0-9_.-]+(/(?!\.)[A-Za-z0-9_.-]+)*$"


def _system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


class NoteSink:
    """A folder of notes, and the store of what is in it."""

    def __init__(self, store: Store, folder: str):
        self.store, self.folder = store, folder.rstrip("/")

    def table(self, state: dict | None = None) -> DataFrame:
        name = (self.store.latest()[1] if state is None else state).get("notes")
        return self.store.read(name, TABLE) if name else self.store.spark.createDataFrame([], TABLE)

    def write(self, notes: DataFrame) -> dict:
        """(path, body) -> how many files were written and removed. Of rows that share a path
        the least body counts; a null body is an empty file; paths that are no plain relative
        path are refused."""
        self.finish()
        base, state = self.store.latest()
        notes = notes.groupBy("path").agg(F.min(F.coalesce("body", F.lit(""))).alias("body"))
        bad = notes.where(F.col("path").isNull() | ~F.col("path").rlike(PATH)).limit(1).collect()
        if bad:
            raise ValueError(f"no plain relative path: {bad[0]['path']!r}")
        notes = notes.withColumn("digest", F.sha2("body", 256))
        old = self.table(state).withColumnRenamed("digest", "before")
        both = notes.join(old, "path", "left")
        run, folder = uuid.uuid4().hex, self.folder

        def draft(batches):
            system, inner = _system(folder)
            system.create_dir(f"{inner}/.drafts/{run}", recursive=True)
            for batch in batches:
                names = []
                for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    name = f".drafts/{run}/{uuid.uuid4().hex}"
                    with system.open_output_stream(f"{inner}/{name}") as out:
                        out.write(body.encode())
                    names.append(name)
                yield pa.record_batch([batch.column(0), pa.array(names, pa.string())], names=["path", "draft"])

        due = both.where("before IS NULL OR before <> digest").select("path", "body").mapInArrow(draft, MOVES)
        gone = old.join(notes, "path", "left_anti").select("path", F.lit(None).cast("string").alias("draft"))
        moves = self.store.write(due.unionAll(gone), "moves")
        counts = self.store.read(moves, MOVES).agg(F.count("draft").alias("written"), F.count_if(F.col("draft").isNull()).alias("removed")).first().asDict()
        if any(counts.values()):
            self.store.commit(base, {"notes": self.store.write(notes.select("path", "digest"), "notes"), "moves": moves})
            self.finish()
        return counts

    def finish(self) -> None:
        """The second phase of a commit that has one open: each move may be made again."""
        base, state = self.store.latest()
        if not state.get("moves"):
            return
        folder = self.folder

        def move(batches):
            from pyarrow import fs

            system, inner = _system(folder)
            for batch in batches:
                done = 0
                for path, draft in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    final = f"{inner}/{path}"
                    if draft is None:
                        if system.get_file_info(final).type != fs.FileType.NotFound:
                            system.delete_file(final)
                            done += 1
                    elif system.get_file_info(f"{inner}/{draft}").type != fs.FileType.NotFound:
                        system.create_dir(final.rsplit("/", 1)[0], recursive=True)
                        system.move(f"{inner}/{draft}", final)
                        done += 1
                yield pa.record_batch([pa.array([done], pa.int64())], names=["done"])

        self.store.read(state["moves"], MOVES).mapInArrow(move, "done long").agg(F.sum("done")).collect()
        self.store.commit(base, {"notes": state["notes"]})
