"""Live tracker, live similarity and live consensus.

Rows wait in the state until the watermark has passed their frame, so frames may be split over
micro-batches and arrive out of order; what depends on earlier frames sees whole frames in order. Only the last stretch of a
micro-batch, as long as the watermark's delay, waits for the next one, however large the micro-batch is. State is a handful
of flat fields and the rows that wait, per capture, and lives in the state store of the query's checkpoint, so
it survives the loss of an executor. It expires when a capture stays quiet.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from captura.operators.candidates import _best
from captura.operators.temporal import CONSISTENCY_THRESHOLD
from captura.operators.tracking import METHODS, RESULT_COLUMNS, FrameBatch, TrackerConfig, Tracks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on the disks of the executors; what RocksDB holds of it in memory has one bound per executor.

    A micro-batch uploads its changes. Every open store reserves 4 MB of disk, so those of queries that ended are closed soon.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "10s")


TRACK_STATE = "last_ms bigint, pending binary, tracks binary"
SIMILARITY_STATE = "last_ms bigint, pending binary, frame_idx bigint, vec array<double>"
EXPIRY = GroupStateTimeout.EventTimeTimeout
QUAD = [f"q{i}" for i in range(8)]
BOX = [f"b{i}" for i in range(4)]


def _stored(rows: pd.DataFrame) -> bytes:
    """Rows as an Arrow stream, the form in which they wait in the state store."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _watermarked(rows: DataFrame, delay: str) -> tuple[DataFrame, int]:
    """The stream with its watermark, and the delay in milliseconds as Spark reads it."""
    marked = rows.withWatermark("event_time", delay)
    return marked, marked.schema["event_time"].metadata["spark.watermarkDelayMs"]


class Waiting:
    """Rows of one group that arrived, split by the watermark: rows before it are complete, the others wait on.

    Frames may be split over micro-batches and come out of order by less than the watermark's delay; what waits
    is the data of that stretch of time. Spark moves its watermark only after a micro-batch, to the latest time of all groups less the delay.
    Rows that lie so far behind the latest of their own group will be behind it then, so they are complete already: a
    backlog that comes as one micro-batch does not wait in the state. Spark drops rows that arrive behind its watermark.
    """

    def __init__(self, pdfs: Iterator[pd.DataFrame], store: GroupState, delay_ms: int):
        self.store, self.state = store, store.get if store.exists else None
        parts = [] if store.hasTimedOut else [p.drop(columns="event_time") for p in pdfs if len(p)]
        if self.state is not None and len(self.state[1]):
            parts.insert(0, pa.ipc.open_stream(bytes(self.state[1])).read_pandas())
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"ms": pd.Series(dtype="int64"), "key": pd.Series(dtype=object)})
        mark = max(store.getCurrentWatermarkMs(), int(rows["ms"].max()) - delay_ms) if len(rows) else 0
        passed = (rows["ms"] <= mark).to_numpy(bool)
        self.ready, self.rest = rows[passed], rows[~passed]
        before = self.state[0] if self.state is not None else 0
        self.last_ms = max(before, int(self.ready["ms"].max())) if len(self.ready) else before

    def expired(self, idle_ms: int) -> bool:
        """Whether the capture has been quiet for so long that its state is void."""
        now = self.store.getCurrentWatermarkMs()
        return not len(self.ready) and not len(self.rest) and self.last_ms + idle_ms < now

    def keep(self, state: tuple, idle_ms: int) -> None:
        """Store the state with the rows that wait, and ask to be called when the first of them is due or the state expires."""
        self.store.update((self.last_ms, _stored(self.rest) if len(self.rest) else b"", *state))
        due = int(self.rest["ms"].min()) if len(self.rest) else self.last_ms + idle_ms
        self.store.setTimeoutTimestamp(max(due, self.store.getCurrentWatermarkMs() + 1))


class KnownTracks:
    """Tracks of the captures of one shard, between micro-batches a table of key, last frame's time and flat state."""

    def __init__(self, stored: bytes | None):
        flat_columns = ["last_ms", "known", "area", "aspect", "lost", *QUAD]
        empty = pd.DataFrame({"key": pd.Series(dtype=object), **{c: pd.Series(dtype=float) for c in flat_columns}})
        self.rows = pa.ipc.open_stream(bytes(stored)).read_pandas() if stored else empty

    def of(self, names) -> tuple[Tracks, np.ndarray]:
        """Tracks of the named captures and the times of their last frames, 0 for new ones."""
        tracks, last = Tracks(len(names)), np.zeros(len(names), np.int64)
        place = pd.Index(self.rows["key"]).get_indexer(names)
        old = np.flatnonzero(place >= 0)
        rows = self.rows.iloc[place[old]]
        last[old] = rows["last_ms"].to_numpy()
        tracks.known[old], tracks.lost[old] = rows["known"].to_numpy(bool), rows["lost"].to_numpy()
        tracks.area[old], tracks.aspect[old] = rows["area"].to_numpy(float), rows["aspect"].to_numpy(float)
        tracks.quad[old] = rows[QUAD].to_numpy(float).reshape(-1, 4, 2)
        return tracks, last

    def put(self, names, tracks: Tracks, last: np.ndarray) -> None:
        state = {"last_ms": last, "known": tracks.known, "area": tracks.area, "aspect": tracks.aspect, "lost": tracks.lost}
        quads = dict(zip(QUAD, tracks.quad.reshape(-1, 8).T))
        others = self.rows[~self.rows["key"].isin(names)]
        now = pd.DataFrame({"key": names, **state, **quads})
        self.rows = pd.concat([others, now], ignore_index=True) if len(others) else now

    def expire(self, before: int) -> None:
        self.rows = self.rows[self.rows["last_ms"] >= before]


def track_stream(
    rows: DataFrame, cfg: TrackerConfig = TrackerConfig(), delay: str = "10 seconds", idle_ms: int = 600_000, shards: int = 512
) -> DataFrame:
    """Tracked detections from a stream of candidate rows, in append mode.

    Rows carry ``video_id, frame_idx, event_time, frame_w, frame_h, cand_id, corners, area,
    aspect_ratio, static_score``; a frame without candidates has one row with NULL ``cand_id``, and the rows of a frame
    share its event time. A frame is tracked once the watermark, ``delay`` behind the latest event time, has passed it, so
    its rows may come in several micro-batches; frames go in order of event time, then index. Rows that come after a later frame of
    their capture was tracked are dropped. After ``idle_ms`` without a frame
    a capture loses its state, as after too many lost frames. Captures are hashed into ``shards``, each with one state, whose
    captures advance together; a task holds the tracks of one shard and its rows of a micro-batch, so take more of them for more
    captures or larger micro-batches. The number is part of the checkpoint.
    """
    kinds = dict(rows.dtypes)
    marked, delay_ms = _watermarked(rows, delay)
    corner = [F.get("corners", F.lit(i))[axis].cast("double") for i in range(4) for axis in ("x", "y")]
    slim = marked.select(
        F.pmod(F.xxhash64("video_id"), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce(F.concat(F.lit("="), F.col("video_id").cast("string")), F.lit("")).alias("key"),  # NULL is a capture of its own
        "frame_idx",
        "event_time",
        F.unix_millis("event_time").alias("ms"),
        F.col("frame_w").cast("double").alias("frame_w"),
        F.col("frame_h").cast("double").alias("frame_h"),
        F.when(F.size("corners") == 4, F.col("cand_id")).cast("double").alias("cand_id"),
        *[c.alias(name) for c, name in zip(corner, QUAD)],
        F.col("area").cast("double").alias("area"),
        F.col("aspect_ratio").cast("double").alias("aspect"),
        (-F.coalesce(F.col("static_score").cast("double"), F.lit(0.0))).alias("rank"),
    )

    def batch_of(rows: pd.DataFrame, first: np.ndarray) -> FrameBatch:
        """Sorted rows as frames; ``first`` has the first row of each."""
        real = rows["cand_id"].notna().to_numpy()
        ends = np.append(np.append(0, np.cumsum(real))[first], real.sum()).astype(np.int32)
        cands = rows[real]
        fields = {c: pa.array(cands[c].to_numpy(float)) for c in ("rank", "area", "aspect")}
        eight = pa.array(np.arange(0, 8 * len(cands) + 1, 8, dtype=np.int32))
        fields["quad"] = pa.ListArray.from_arrays(eight, pa.array(cands[QUAD].to_numpy(float).ravel()))
        entries = pa.StructArray.from_arrays(list(fields.values()), list(fields))
        sizes = [pa.array(rows[c].to_numpy(float)[first]) for c in ("frame_w", "frame_h")]
        none = pa.nulls(len(first), pa.list_(pa.float64()))
        columns = [*sizes, pa.ListArray.from_arrays(pa.array(ends), entries), none]
        return FrameBatch(pa.RecordBatch.from_arrays(columns, ["frame_w", "frame_h", "cands", "tier2"]))

    def advance(shard, pdfs: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        given = Waiting(pdfs, store, delay_ms)
        captures = KnownTracks(given.state[2] if given.state is not None else None)
        codes, names = pd.factorize(given.ready["key"])
        tracks, last = captures.of(names)
        in_time = (last[codes] <= 0) | (given.ready["ms"].to_numpy() > last[codes])
        if in_time.any():
            ready = given.ready.assign(code=codes)[in_time].sort_values(["code", "ms", "frame_idx", "rank", "cand_id"], kind="stable")
            code, ms, index = (ready[c].to_numpy() for c in ("code", "ms", "frame_idx"))
            first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (ms[1:] != ms[:-1]) | (index[1:] != index[:-1])])
            work, time = batch_of(ready, first), ms[first]
            start = np.flatnonzero(np.r_[True, np.diff(code[first]) != 0])
            size = np.diff(np.append(start, len(first)))
            mine = code[first][start]  # the track of each capture that has frames
            at = np.argsort(-size, kind="stable")
            for t in range(size.max()):
                at = at[: np.searchsorted(-size[at], -t, "left")]
                frames, track = start[at] + t, mine[at]
                quiet = track[(last[track] > 0) & (time[frames] - last[track] > idle_ms)]
                tracks.copy_from(quiet, Tracks(len(quiet)), slice(None))
                last[track] = time[frames]
                work.step(tracks, frames, track, cfg)
            captures.put(np.asarray(names, object), tracks, last)
            quads = dict(zip(QUAD, work.corners.reshape(-1, 8).T))
            boxes = dict(zip(BOX, work.box.T.astype(np.int32)))
            scores = {"confidence": work.score, "static_score": work.best_static, "temporal_score": work.similar, "reason": work.reasons(cfg)}
            yield pd.DataFrame({"key": ready["key"].to_numpy()[first], "frame_idx": index[first], "outcome": work.outcome.astype(np.int32), **quads, **boxes, **scores})
        now = store.getCurrentWatermarkMs()
        captures.expire(now - idle_ms)
        due = [int(x.min()) + d for x, d in ((given.rest["ms"], 0), (captures.rows["last_ms"], idle_ms)) if len(x)]
        if not due:
            store.remove()
            return
        store.update((given.last_ms, _stored(given.rest) if len(given.rest) else b"", _stored(captures.rows) if len(captures.rows) else b""))
        store.setTimeoutTimestamp(max(min(due), now + 1))

    numbers = ", ".join([*(f"{c} double" for c in QUAD), *(f"{c} int" for c in BOX), *(f"{c} double" for c in RESULT_COLUMNS[4:7])])
    found = slim.groupBy("shard").applyInPandasWithState(
        advance, f"key string, frame_idx {kinds['frame_idx']}, outcome int, {numbers}, reason string", TRACK_STATE, "append", EXPIRY
    )
    taken = F.col("outcome") >= 2
    shown = {
        "video_id": F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).cast(kinds["video_id"]),
        "detected": taken,
        "method": F.get(F.array(*map(F.lit, METHODS)), F.col("outcome")),
        "corners": F.when(taken, F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in zip(QUAD[::2], QUAD[1::2])])),
        "bbox": F.when(taken, F.array(*BOX)),
    }
    return found.select(*[shown[c].alias(c) if c in shown else c for c in ("video_id", "frame_idx", *RESULT_COLUMNS)])


def similarity_stream(
    emb: DataFrame, threshold: float = CONSISTENCY_THRESHOLD, delay: str = "10 seconds", idle_ms: int = 600_000
) -> DataFrame:
    """Consecutive similarities and anomaly flags from a stream of ``video_id, frame_idx, event_time, vec``.

    A frame is compared once the watermark has passed it, so frames that arrive out of order within ``delay`` meet their
    true neighbour; later ones are dropped and their neighbours are compared with each other. The last vector of each
    capture is kept until no frame has come for ``idle_ms``.
    """
    marked, delay_ms = _watermarked(emb, delay)
    slim = (
        marked.filter(F.col("vec").isNotNull() & (F.size("vec") > 0))
        .select("video_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), "event_time", F.unix_millis("event_time").alias("ms"), F.col("vec").cast("array<double>").alias("vec"))
    )

    def advance(key, pdfs: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        given = Waiting(pdfs, store, delay_ms)
        if given.expired(idle_ms):
            store.remove()
            return
        ready = given.ready.sort_values(["ms", "frame_idx"], kind="stable") if len(given.ready) else pd.DataFrame({"ms": [], "frame_idx": [], "vec": []})
        if given.state is not None and len(given.state[3]):
            ready = ready[ready["ms"] > given.state[0]]  # later frames of the capture have been compared
        times, index = [int(x) for x in ready["ms"]], [int(x) for x in ready["frame_idx"]]
        vectors = [np.asarray(v, dtype=float) for v in ready["vec"]]
        if given.state is not None and len(given.state[3]):
            times, index = [given.state[0], *times], [given.state[2], *index]
            vectors = [np.asarray(given.state[3], dtype=float), *vectors]
        near = [k for k in range(1, len(times)) if times[k] - times[k - 1] <= idle_ms]
        if near:
            sims = np.array([min(1.0, max(0.0, float(vectors[k - 1] @ vectors[k]))) for k in near])
            pairs = {"frame_a": [index[k - 1] for k in near], "frame_b": [index[k] for k in near]}
            yield pd.DataFrame({"video_id": [key[0]] * len(near), **pairs, "similarity": np.rint(sims * 1e4) / 1e4, "is_anomaly": sims < threshold})
        given.keep((index[-1], vectors[-1].tolist()) if index else (0, []), idle_ms)

    kind = dict(emb.dtypes)["video_id"]
    return slim.groupBy("video_id").applyInPandasWithState(
        advance, f"video_id {kind}, frame_a bigint, frame_b bigint, similarity double, is_anomaly boolean", SIMILARITY_STATE, "append", EXPIRY
    )


def consensus_counts_stream(values: DataFrame) -> DataFrame:
    """Running tally per capture, field and value; run it in update or complete mode."""
    present = values.filter(F.col("value").isNotNull())
    return present.groupBy("video_id", "field", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("first_seen")
    )


def leading_values(tallies: DataFrame) -> DataFrame:
    """Current consensus from tallies: most frequent, then first seen. Use inside ``foreachBatch``."""
    ranked = _best(tallies, ["video_id", "field"], [-F.col("n"), F.col("first_seen"), F.col("value")])
    return ranked.select("video_id", "field", F.col("value").alias("consensus"), F.col("n").alias("frequency"))


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Drain the available input into a parquet table below ``folder`` and read it back.

    ``folder`` must be on storage that all executors share. In ``update`` mode every
    micro-batch writes its changed rows with a batch number.
    """
    spark = stream.sparkSession
    out, checkpoint = f"{folder}/table", f"{folder}/checkpoint"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:

        def save(batch: DataFrame, number: int) -> None:
            # Overwriting the folder of a batch makes a repeated batch harmless.
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.parquet(out)
