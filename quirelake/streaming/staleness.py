"""Staleness of remembered records from a stream of document versions.

Two sorts of events come in one stream, each for a document's path: a version of
the document (its text, or null when it was deleted) and a save of a record that
was made from it. State is kept by path, paths dealt to ``PLACES``: the digest of the last version, its
place, the place of the last change, and the ids of the records that are
current. A version with another digest is a change: it makes those records
stale, each once, and forgets them until they are saved again. A version with
the same digest changes nothing.

Events are taken in the order of seq within a batch. A version that comes after
a later one of its document is passed over; a record saved before a change that
is known already is stale at once.

Only digests travel: a text is hashed where it is read. The state needs the
RocksDB provider, which ``stale_records`` sets for its own session; what is
written goes through the file sink, so that an interrupted run, started again
from its checkpoint, neither loses nor repeats a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from quirelake.functions.workers import workers_see_package

#: id is null for a version of the document; text is null for a record and for a deleted document.
EVENTS = "path string, seq long, id string, text string"
STALE = "id string, path string, seq long, change string"


#: Paths are dealt to so many places of the state; a checkpoint holds for the number that it was made with.
PLACES = 1 << 14


class Watch(StatefulProcessor):
    """What is known of the paths of one place is one value, read once and written once for each batch that names one of them: every call to the state is a round trip."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType().add("path", StringType()).add("digest", StringType()).add("seq", LongType()).add("changed", LongType()).add("current", ArrayType(StringType()))
        self.known = handle.getValueState("known", StructType().add("paths", ArrayType(kind)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        held = self.known.get()
        known = {path: (digest, last, changed, list(current)) for path, digest, last, changed, current in (held[0] if held else ())}
        begun = dict(known)
        for path, own in groupby(sorted(rows, key=lambda r: (r.path, r.seq, r.id is not None, r.id or "")), lambda r: r.path):
            digest, last, changed, ids = known.get(path, (None, None, None, ()))
            current = dict.fromkeys(ids)
            for row in own:
                if row.id is not None:
                    if changed is not None and row.seq < changed:
                        yield Row(id=row.id, path=path, seq=changed, change="changed" if digest else "deleted")
                    else:
                        current[row.id] = None
                    continue
                if last is not None and row.seq <= last:
                    continue
                if last is not None and row.digest != digest:
                    changed, kind = row.seq, "changed" if row.digest else "deleted"
                    for id_ in current:
                        yield Row(id=id_, path=path, seq=row.seq, change=kind)
                    current.clear()
                digest, last = row.digest, row.seq
            known[path] = (digest, last, changed, list(current))
        if known != begun:
            self.known.update(([(path, *state) for path, state in known.items()],))

    def close(self) -> None:
        pass


def stale(events: DataFrame) -> DataFrame:
    """A streaming DataFrame of records that become stale (STALE), of one of EVENTS."""
    workers_see_package(events.sparkSession)
    hashed = events.select("path", "seq", "id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).where("path IS NOT NULL AND seq IS NOT NULL")
    return hashed.withColumn("place", F.pmod(F.xxhash64("path"), F.lit(PLACES))).groupBy("place").transformWithState(Watch(), STALE, "Append", "None")


def stale_records(spark: SparkSession, source: str, out: str, checkpoint: str, files_per_batch: int = 1_000) -> None:
    """Take what is new in a Parquet folder of EVENTS, and append the records that became stale to the folder out. Can be called again and again."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    events = own.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run = stale(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
