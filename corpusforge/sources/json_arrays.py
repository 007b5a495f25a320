"""Large JSON files: the elements of one array, read by byte ranges.

A byte range does not tell whether it begins inside a string or how deep it lies. So
each range is scanned first for both cases, a running sum over the ranges of a file gives
every range its true beginning, and then each range gives out the elements that begin in
it. A task holds one range and one element, whatever the size of the file. It takes
many short ranges one after another, so short files and ranges do not make short tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.session import stored
from corpusforge.sources.readers import input_paths

RANGE_BYTES = 8 << 20
TASK_BYTES = 32 << 20
BAD = "_bad"
QUOTE, SLASH, COMMA, OPEN, CLOSE = 34, 92, 44, 91, 93  # " \ , [ ]
OPEN_OBJECT, CLOSE_OBJECT = 123, 125


def open_file(path: str) -> pa.NativeFile:
    """A local file or one of a store that pyarrow knows (hdfs, s3, gs, abfss)."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, inner = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def begins_escaped(file: pa.NativeFile, at: int) -> bool:
    """Whether an odd number of backslashes stands right before ``at``."""
    run = 0
    while at:
        size = min(at, 256)
        file.seek(at - size)
        piece = file.read(size)
        tail = len(piece) - len(piece.rstrip(b"\\"))
        run, at = run + tail, at - size
        if tail < size:
            break
    return run % 2 == 1


@dataclass
class Marks:
    """Brackets and commas outside strings: place, byte, and the depth after each."""

    place: np.ndarray
    byte: np.ndarray
    depth: np.ndarray
    quotes: int
    inside: bool


def marks(data: bytes, escaped: bool, inside: bool, depth: int = 0) -> Marks:
    """``escaped`` and ``inside`` (a string) hold for the first byte of ``data``."""
    bytes_ = np.frombuffer(data, np.uint8)
    if escaped:
        bytes_ = bytes_.copy()
        bytes_[:1] = 32
    quote = bytes_ == QUOTE
    slashes = np.flatnonzero(bytes_ == SLASH)
    if len(slashes):
        first = np.concatenate([[True], np.diff(slashes) > 1])
        start = slashes[np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0))]
        hidden = slashes[(slashes - start) % 2 == 0] + 1  # what an odd backslash stands before
        quote[hidden[hidden < len(quote)]] = False
    within = (np.cumsum(quote, dtype=np.uint8) + np.uint8(inside)) & 1
    step = np.zeros(256, np.int8)
    step[[OPEN, OPEN_OBJECT]], step[[CLOSE, CLOSE_OBJECT]] = 1, -1
    place = np.flatnonzero((within == 0) & ((step[bytes_] != 0) | (bytes_ == COMMA)))
    byte = bytes_[place]
    return Marks(place, byte, depth + np.cumsum(step[byte], dtype=np.int64), int(quote.sum()),
                 bool(within[-1]) if len(within) else inside)


def key_before(data: bytes, at: int, file: pa.NativeFile, base: int) -> str:
    """The key of the value that begins at ``at``, read on to the left where it lies before ``data``."""
    reach = 256
    while True:
        low = max(0, base + at - reach)
        file.seek(low)
        left = file.read(base + at - low).rstrip()
        if left.endswith(b":"):
            name = left[:-1].rstrip()
            begin = name.rfind(b'"', 0, len(name) - 1)
            while begin > 0 and name[begin - 1] == SLASH:
                begin = name.rfind(b'"', 0, begin)
            if begin >= 0:
                return name[begin + 1 : -1].decode("utf-8", "replace")
        elif left:
            return ""
        if low == 0:
            return ""
        reach *= 4


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each range and its change of depth, if it begins outside and inside a string."""
    for batch in batches:
        scanned = []
        for row in batch.to_pylist():
            with open_file(row["file"]) as file:
                escaped = begins_escaped(file, row["start"])
                file.seek(row["start"])
                data = file.read(row["size"])
            both = [marks(data, escaped, inside) for inside in (False, True)]
            out, in_ = (int(m.depth[-1]) if len(m.depth) else 0 for m in both)
            scanned.append(row | {"escaped": escaped, "quotes": both[0].quotes, "d_out": out, "d_in": in_})
        if scanned:
            yield pa.RecordBatch.from_pylist(scanned)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of the last value of the outer object that opens in each range ("" for objects)."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("key", pa.string())])
    for batch in batches:
        keys = []
        for row in batch.to_pylist():
            with open_file(row["file"]) as file:
                file.seek(row["start"])
                data = file.read(row["size"])
                found = marks(data, row["escaped"], row["inside"], row["depth"])
                opens = np.flatnonzero((found.depth == 2) & np.isin(found.byte, [OPEN, OPEN_OBJECT]))
                key = None
                if len(opens):
                    last = opens[-1]
                    key = "" if found.byte[last] == OPEN_OBJECT else key_before(
                        data, int(found.place[last]), file, row["start"])
            keys.append({"file": row["file"], "start": row["start"], "key": key})
        yield pa.RecordBatch.from_pylist(keys, schema)


def _elements(field: str | None, size: int):
    level = 1 if field is None else 2
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("element", pa.string()), ("error", pa.string())])

    def of_range(file: pa.NativeFile, row: dict) -> Iterator[dict]:
        at, live = row["start"], row["live"]
        escaped, inside, depth = row["escaped"], row["inside"], row["depth"]
        begun: int | None = None  # place after the separator before the element that is open
        text = b""
        opened = False  # the open element is the first of its array
        while True:
            file.seek(at)
            data = file.read(row["size"] if at == row["start"] else size)
            if not data:
                if begun is not None:
                    yield {"file": row["file"], "offset": begun, "element": text.decode("utf-8", "replace"),
                           "error": "the file ends inside an element"}
                return
            found = marks(data, escaped, inside, depth)
            own, cut = at == row["start"], 0
            for place, byte, after in zip(found.place.tolist(), found.byte.tolist(), found.depth.tolist()):
                begins = after == level and byte in (OPEN, OPEN_OBJECT)
                if begins:
                    live = byte == OPEN and (field is None or key_before(data, place, file, at) == field)
                separates = live and ((byte == COMMA and after == level) or (after == level - 1 and byte in (CLOSE, CLOSE_OBJECT)))
                if begun is not None and separates:
                    whole = (text + data[cut:place]).strip()
                    if whole or byte == COMMA or not opened:
                        yield {"file": row["file"], "offset": begun, "element": whole.decode("utf-8", "replace"),
                               "error": None if whole else "an empty element"}
                    begun, text = None, b""
                    if not own:
                        return
                if live and own and (begins or (separates and byte == COMMA)):
                    begun, cut, opened = at + place + 1, place + 1, begins
                if after == level - 1 and byte in (CLOSE, CLOSE_OBJECT):
                    live = False
            if begun is None:
                return
            text, at = text + data[cut:], at + len(data)
            inside = found.inside
            depth = int(found.depth[-1]) if len(found.depth) else depth
            escaped = begins_escaped(file, at)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["file"]) as file:
                    for element in of_range(file, row):
                        held.append(element)
                        weight += len(element["element"]) + 64  # empty elements have places, too
                        if weight > 1 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return elements


def list_below(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """The files below ``root``, listed at once. Spark would ask for each folder, up to 10,000, by a task of its own."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(min(int(usual), max(32, 4 * spark.sparkContext.defaultParallelism))))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    finally:
        spark.conf.set(key, usual)


def read_json_arrays(spark: SparkSession, root: str, schema: T.StructType | str, field: str | None = None,
                     pattern: str = "*.json", range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The elements of the array in each JSON file below ``root``, as ``(good, bad)``.

    The array is the file itself, or the value of ``field`` in the object that the file is.
    ``good`` has the columns of ``schema``, ``file`` and ``offset``, the byte after the mark
    before the element. ``bad`` (file, offset, element, error) has elements that do not parse,
    and files that end too early, close too much or are empty. Elements before
    an error stay; one that is open where the file ends is bad. A file is read by ranges of
    ``range_bytes``; a task takes as many of them as come to about ``TASK_BYTES``.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    found = list_below(spark, root, pattern)
    lengths = [tuple(r) for r in found.select("path", "length").collect()]
    files = spark.createDataFrame(lengths, "file string, length long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.select("file", F.explode(starts).alias("start"), "length").select(
        "file", "start", F.least(F.lit(range_bytes), F.col("length") - F.col("start")).alias("size"))
    n = sum(max(1, -(-length // range_bytes)) for _, length in lengths)
    # An own number: the rows are so few bytes that Spark would put all ranges into one task.
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-sum(length for _, length in lengths) // TASK_BYTES))))
    scanned = stored(ranges.repartition(tasks, "file", "start").mapInArrow(
        _scan, "file string, start long, size long, escaped boolean, quotes long, d_out long, d_in long"))

    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    change = F.when(F.col("inside"), F.col("d_in")).otherwise(F.col("d_out"))
    placed = scanned.withColumn("inside", inside).withColumn("change", change).withColumn(
        "depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
    if field is None:
        placed = placed.withColumn("live", F.col("depth") >= 1)
    else:
        keys = placed.repartition(tasks, "file", "start").mapInArrow(_keys, "file string, start long, key string")
        known = placed.join(keys, ["file", "start"])
        open_key = F.last("key", ignorenulls=True).over(earlier)
        placed = known.withColumn("live", (F.col("depth") >= 2) & F.coalesce(open_key == field, F.lit(False)))
    placed = stored(placed)

    elements = placed.repartition(tasks, "file", "start").mapInArrow(
        _elements(field, range_bytes), "file string, offset long, element string, error string")
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    row = F.from_json("element", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    parsed = elements.withColumn("_row", F.explode(F.array(row)))
    fine = F.col("error").isNull() & F.col("_row").isNotNull() & F.col(f"_row.{BAD}").isNull()
    parsed = stored(parsed.select("file", "offset", "_row", fine.alias("_fine"), "error",
                                  F.when(~fine, F.col("element")).alias("element")))
    good = parsed.where("_fine").select("_row.*", "file", "offset").drop(BAD)
    broken = parsed.where("NOT _fine").select("file", "offset", "element", F.coalesce("error", F.lit("no such row")).alias("error"))
    ends = placed.groupBy("file").agg(
        F.sum("size").alias("offset"), F.sum("change").alias("open"), (F.sum("quotes") % 2).alias("quoted"))
    listed = spark.createDataFrame([(f,) for f in input_paths(found)], "file string")
    unfinished = listed.join(ends, "file", "left").withColumn("error", F.when(
        F.col("offset").isNull(), "an empty file").when(F.col("quoted") == 1, "the file ends inside a string").when(
        F.col("open") > 0, "the file ends inside a bracket").when(F.col("open") < 0, "more brackets close than open"))
    return good, broken.unionByName(
        unfinished.where("error IS NOT NULL").select("file", "offset", F.lit(None).cast("string").alias("element"), "error"))
