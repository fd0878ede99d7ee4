"""Streams with keyed state: the block latch, scans in progress, products folded from sightings.

State lives in the state store, by key, with the version of its shape; a checkpoint written by another version is refused
rather than misread. Results depend on what has arrived, by its sequence numbers, and not on how files were dealt to
micro-batches. A key's rows of one micro-batch meet in one task; `landed(..., files=)` bounds a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_VERSION = 1
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ForeignState(ValueError):
    """State that another version of this code has written."""


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same cluster for streams with state: their store on disk, and the number of partitions it is dealt to for
    good, since a checkpoint can't be dealt anew (one a core, 8 at least)."""
    partitions = partitions or max(8, spark.sparkContext.defaultParallelism)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


class _Versioned(StatefulProcessor):
    """A processor whose state of each key carries the version of its shape."""

    def __init__(self, version: int, ttl_ms: int | None = None):
        self.version, self.ttl = version, ttl_ms

    def known(self, state) -> tuple | None:
        """The key's state without its version; None if there is none yet."""
        held = state.get()
        if held is None:
            return None
        version, *rest = held
        if version != self.version:
            raise ForeignState(f"state of version {version}; this code reads version {self.version}")
        return tuple(rest)

    def close(self) -> None:
        pass


class _Latch(_Versioned):
    def __init__(self, seq: str, version: int):
        super().__init__(version)
        self.seq = seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("blocked", "version int, seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, d = self.known(self.first), list(rows)
        limit = known[0] if known else None
        hit = min((r[self.seq] for r in d if r["block"] is not None), default=None)
        if hit is not None and (limit is None or hit < limit):
            limit = int(hit)
            self.first.update((self.version, limit))
        yield from (r for r in d if limit is None or r[self.seq] < limit)


def stream_block_latch(responses: DataFrame, *, scope: str = "scan_id", seq: str = "seq", version: int = STATE_VERSION) -> DataFrame:
    """Rows (scope, seq, block, ...) before the first block of their scope, as detect_blocks names it: once a scope is blocked, what comes
    after in this or any later file is gone, also after a restart. A late row from before the block still comes. Rows without a
    seq or a scope can't be placed: those without a seq are left out, those without a scope are one scope."""
    d = responses.where(F.col(seq).isNotNull())
    return d.groupBy(scope).transformWithState(_Latch(seq, version), d.schema, "Append", "None")


SCANS = "pages long, repeats long, products long, last_seq long, status string"


class _Scans(_Versioned):
    def __init__(self, scope: str, version: int):
        super().__init__(version)
        self.row = Row(scope, *(c.split()[0] for c in SCANS.split(", ")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "version int, pages long, repeats long, products long, last_seq long, status string")
        self.visited = handle.getMapState("visited", "url string", "seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.known(self.total)
        pages, repeats, products, last, status = before = known or (0, 0, 0, -1, "running")
        read: set[str] = set()  # in this micro-batch; nobody asks the store of them, or of a scan that it doesn't know
        for r in sorted(rows, key=lambda r: r["seq"]) if status == "running" else ():
            last = max(last, r["seq"])
            if r["block"] is not None:
                status = "blocked"
                break
            if r["url"] in read or known and self.visited.containsKey((r["url"],)):
                repeats += 1
            else:
                self.visited.updateValue((r["url"],), (r["seq"],))
                pages, products = pages + 1, products + r["n_products"]
            read.add(r["url"])
        now = (pages, repeats, products, last, status)
        if now != before:
            self.total.update((self.version, *now))
            yield self.row(key[0], *now)


def stream_scans(pages: DataFrame, *, scope: str = "scan_id", version: int = STATE_VERSION) -> DataFrame:
    """How far each scan is, after each micro-batch that changed it: (scope, pages, repeats, products, last_seq, status) of page rows
    (scope, seq, url, n_products, block). A page that was read before isn't counted again, whenever that was; a blocked scan stays
    blocked and takes no more rows, also after a restart. Update mode."""
    d = pages.where(F.col("seq").isNotNull()).select(F.col(scope), F.col("seq").cast("long").alias("seq"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("n_products").cast("long"), F.lit(0).cast("long")).alias("n_products"), "block")
    out = T.StructType([d.schema[scope], *T._parse_datatype_string(SCANS).fields])
    return d.groupBy(scope).transformWithState(_Scans(scope, version), out, "Update", "None")


class _Products(_Versioned):
    def __init__(self, key: str, fields: list[str], seq: str, version: int, ttl_ms: int | None):
        super().__init__(version, ttl_ms)
        self.key, self.fields, self.seq = key, fields, seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getMapState("best", "field string", "version int, value string, confidence double, seq long", ttlDurationMs=self.ttl)
        self.seen = handle.getValueState("seen", "version int, first_seq long, n long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.known(self.seen)
        first, n = known or (None, 0)
        held = {f: (self.best.getValue((f,))[1:] if known and self.best.containsKey((f,)) else None) for f in self.fields}
        before, was = dict(held), first
        for r in rows:
            n, seq = n + 1, r[self.seq]
            if seq is None:
                continue
            first = seq if first is None else min(first, seq)
            for f in self.fields:
                value, sure = r[f], r[f"{f}_conf"]
                if value is None or not value.strip():
                    continue
                new = (value, float(sure) if sure is not None and sure == sure else -1.0, seq)
                old = held[f]
                if old is None or (new[1], -new[2]) > (old[1], -old[2]):
                    held[f] = new
        self.seen.update((self.version, first, n))
        for f in self.fields:
            if held[f] is not None and held[f] != before[f]:
                self.best.updateValue((f,), (self.version, *held[f]))
        if held != before or first != was:
            yield Row(self.key, *self.fields, "first_seq", "n")(key[0], *[held[f][0] if held[f] else None for f in self.fields], first, n)


def stream_products(sightings: DataFrame, fields: list[str], *, key: str, seq: str, version: int = STATE_VERSION, ttl_ms: int | None = None) -> DataFrame:
    """The surest value of each field of each key so far, of equals the one of the least seq, whenever it arrives: (key, fields as
    text, first_seq, n). A key is emitted only by a micro-batch that changed a value of it or its first seq. sightings: key, seq, and
    for each field its value and `<field>_conf`; blank values say nothing, an unstated confidence counts as -1. ttl_ms: how long a key without new
    rows is kept (for good if None). Update mode."""
    d = sightings.select(key, F.col(seq).cast("long").alias(seq), *[F.col(f).cast("string").alias(f) for f in fields], *[F.col(f"{f}_conf").cast("double").alias(f"{f}_conf") for f in fields])
    out = T.StructType([d.schema[key], *[T.StructField(f, T.StringType()) for f in fields], T.StructField("first_seq", T.LongType()), T.StructField("n", T.LongType())])
    return d.groupBy(key).transformWithState(_Products(key, fields, seq, version, ttl_ms), out, "Update", "ProcessingTime" if ttl_ms else "None")


def run_batches(stream: DataFrame, out: str, checkpoint: str, *, mode: str) -> None:
    """Reads what has landed and stops; a rerun goes on from the checkpoint. Each micro-batch has its own folder (`batch=n`), which a
    repeated one overwrites, so that no row comes twice."""

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def landed_in_steps(steps: list[DataFrame], at: str, spark: SparkSession, shape: Callable[[DataFrame], DataFrame], *, mode: str) -> None:
    """Lands the steps' rows one after the other, and runs the stream to its end after each, from the checkpoint that the run before left."""
    for n, step in enumerate(steps):
        step.write.mode("overwrite").parquet(f"{at}/in/step={n}")
        stream = spark.readStream.schema(step.schema).parquet(f"{at}/in/step=*")
        run_batches(shape(stream), f"{at}/out", f"{at}/state", mode=mode)
