"""Readers of sensor data in the formats of its publishers.

All are text, JSON, Parquet or binary-file readers of Spark, so any file system that Spark reads will do.
What cannot be mapped or parsed raises; nothing is guessed.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import binary
from ..functions.lookups import BEARINGS, OPERATING_POINTS, PUMPS, SPEEDS, look_up, parse_condition, refused

IN_PER_S = 25.4
#: Labels, published columns and channels of the sources.
LABELS = {"Normal": "healthy", "Unbalance": "unbalance", "Misalignment": "misalignment", "Rubbing": "rubbing", "Faulty sensor": "faulty_sensor"}
PUBLISHED = ["median(8,13)", "rms(98,102)", "median(98,102)", "peak1x", "peak2x", "a", "b"]
CHANNELS = ["ACR_Mot.PV", "ACR_Mot.SV", "ACR_Mot.TV", "ACR_Pmp.PV", "ACR_Pmp.SV", "ACR_Pmp.TV", "Pres.PV", "Temp.PV"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a glob has files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def require(spark: SparkSession, path: str, how: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing; {how}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, n) in file order; only for ingest, where two files are aligned by row.

    A line's number is its place in its split and the lines of the splits before it, which are counted.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))  # a row a split
    before = F.coalesce(F.sum("k").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.withColumn("before", before), ["file", "block"]).select(F.col("value").alias("line"), (F.col("before") + F.col("at") - F.col("first")).alias("n"))


def order_records(spark: SparkSession, features: str, spectrum: str, drop_sensor_faults: bool = False) -> DataFrame:
    """Records of a features file and its row-aligned spectrum file in mm/s."""
    require(spark, features, "download the order-spectrum archive")
    require(spark, spectrum, "download the order-spectrum archive")
    lines = numbered_lines(spark, features)
    header = lines.where("n = 0").first()["line"].split(";")
    cells = F.split("line", ";")
    rec = lines.where("n > 0").select((F.col("n") - 1).alias("row"), *[F.get(cells, F.lit(i)).alias(re.sub(r"[(),]", "_", c)) for i, c in enumerate(header)])
    numbers = F.transform(F.split(F.regexp_replace("line", ";$", ""), ";"), lambda x: (x.cast("float") * IN_PER_S).cast("float"))
    spec = numbered_lines(spark, spectrum).select(F.col("n").alias("row"), numbers.alias("spectrum"))
    n, m = rec.count(), spec.count()
    if n != m:
        raise ValueError(f"spectrum has {m} rows but features have {n}")
    published = [re.sub(r"[(),]", "_", c) for c in PUBLISHED if c in header]
    out = rec.join(spec, "row").select("row", F.col("id").cast("long").alias("record_id"), F.format_string("esp_%02d", F.col("esp_id").cast("int")).alias("machine"), F.when(F.col("row") >= 0, refused(F.col("label"), LABELS, "label")).alias("label"), *[F.col(c).cast("double") for c in published], "spectrum")
    return out.where(F.col("label") != "faulty_sensor") if drop_sensor_faults else out


def parse_once(spark: SparkSession, path: str, parse, force: bool = False) -> DataFrame:
    """What ``parse()`` gives, written to Parquet the first time and read from there after."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        parse().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def describe(records: DataFrame) -> DataFrame:
    """Rows and machines of each label, and the highest order (S3)."""
    return records.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("machine").alias("machines"), (F.max(F.size("spectrum") - 1) / 3003).alias("max_order"))


def sampling_rate(df: DataFrame, at: str, key: list[str], default: float = 20_000.0) -> DataFrame:
    """1 / median step of each key."""
    step = F.col(at) - F.lag(at).over(Window.partitionBy(*key).orderBy(at))
    per = df.withColumn("__d", step).groupBy(*key).agg(F.expr("percentile(__d, 0.5)").alias("m"))
    return per.select(*key, F.when(F.col("m") > 0, 1 / F.col("m")).otherwise(F.lit(default)).alias("fs"))


def median_step(at: Column) -> Column:
    """Median difference of neighbours in an array of times; null below two."""
    n = F.size(at)
    steps = F.sort_array(F.zip_with(F.slice(at, 2, F.greatest(n - 1, F.lit(0))), F.slice(at, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a))
    return F.transform(F.array(steps), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)[0]


def condition_bursts(spark: SparkSession, root: str, modality: str, channel: str = "ch1", most: int = 8, conditions: list[str] | None = None) -> DataFrame:
    """Bursts of wide files under root/modality/motor/speed/condition (S4-S6): one row a burst, samples in order of time.

    Folders whose speed is no whole number are left out; at most ``most`` burst columns are read.
    """
    glob = f"{root}/{modality}/*/*/*/*-{channel}.csv"
    require(spark, glob, "extract the raw bursts")
    df = spark.read.csv(glob, header=True, inferSchema=False, pathGlobFilter="*.csv").withColumn("__path", F.input_file_name())
    columns = [c for c in df.columns if c not in ("time", "__path")][:most]
    part = lambda i: F.element_at(F.split(F.regexp_replace("__path", "%20", " "), "/"), -i)
    long = df.select(part(4).alias("motor"), part(3).try_cast("int").alias("speed_pct"), part(2).alias("condition"), F.col("time").cast("double").alias("t"), F.posexplode(F.array(*[F.col(f"`{c}`").cast("float") for c in columns])).alias("burst", "x"))
    long = long.where("speed_pct is not null")
    if conditions:
        long = long.where(F.col("condition").isin(conditions))
    waves = long.where("x is not null").groupBy("motor", "speed_pct", "condition", "burst").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("samples"))
    waves = waves.withColumns({"wave": F.col("samples.x"), "step": median_step(F.col("samples.t"))}).drop("samples")
    rpm = F.create_map(*[F.lit(v) for k, r in SPEEDS.items() for v in (f"{k[0]}@{k[1]}", r)])
    waves = parse_condition(waves, "condition").withColumns({"fs": F.when(F.col("step") > 0, 1 / F.col("step")).otherwise(F.lit(20_000.0)), "rpm": rpm[F.concat_ws("@", "motor", F.col("speed_pct").cast("string"))], "pump": look_up(F.col("motor"), PUMPS)})
    return waves.drop("step")


def paired_channels(vibration: DataFrame, current: DataFrame, pair: bool = False, key: Sequence[str] = ("motor", "speed_pct", "condition"), burst: str = "burst") -> DataFrame:
    """Bursts of both modalities by key and number (J1): vibration, current and the other columns of whichever is there.

    The two weren't sampled at once, so current is null unless ``pair`` (J2); then a key that
    both have gives the bursts that both have, and a key of one modality all of its own.
    """
    on = [*key, burst]
    rest = [c for c in vibration.columns if c not in (*on, "wave")]
    side = lambda df, wave, tag: df.select(*on, F.col("wave").alias(wave), F.lit(True).alias(f"__{tag}"), *[F.col(c).alias(f"__{tag}_{c}") for c in rest])
    both = side(vibration, "vibration", "v").join(side(current, "current", "c"), on, "full_outer")
    if pair:
        shared = vibration.select(*key).distinct().join(current.select(*key).distinct(), list(key)).withColumn("__shared", F.lit(True))
        both = both.join(shared, list(key), "left").where("__shared is null or (__v and __c)").drop("__shared")
    else:
        both = both.withColumn("current", F.when(F.lit(False), F.col("current")))
    return both.select(*on, "vibration", "current", *[F.coalesce(f"__v_{c}", f"__c_{c}").alias(c) for c in rest])


def bearing_names(names: DataFrame, most: int) -> DataFrame:
    """Of the distinct ``name`` of recordings, operating point, bearing and number, the first ``most`` of each known bearing and point."""
    part = lambda i: F.regexp_extract("name", r"^(N\d+_M\d+_F\d+)_([A-Z]+\d+)_(.*)$", i)
    names = names.select("name", part(1).alias("operating_point"), part(2).alias("bearing"), F.coalesce(F.regexp_extract("name", r"_([^_]*)$", 1).try_cast("int"), F.lit(0)).alias("measurement")).distinct()
    names = names.withColumns({"label": look_up(F.col("bearing"), BEARINGS), "rpm": look_up(F.col("operating_point"), {k: v[0] for k, v in OPERATING_POINTS.items()})}).where("label is not null and rpm is not null")
    first = names.withColumn("at", F.row_number().over(Window.partitionBy("bearing", "operating_point").orderBy("name"))).where(F.col("at") <= most).drop("at")
    bounded = len(BEARINGS) * len(OPERATING_POINTS) * most <= 10_000  # names at most
    return F.broadcast(first) if bounded else first


def bearing_windows(df: DataFrame, n: int, current: bool, fs: float) -> DataFrame:
    """The first n samples of recordings; one whose vibration is missing or shorter is left out, a shorter current is null."""
    phase = F.when(F.size("current") >= n, F.slice("current", 1, n)) if current and "current" in df.columns else F.lit(None).cast("array<double>")
    df = df.where(F.size("vibration") >= n).withColumns({"vibration": F.slice("vibration", 1, n), "current": phase})
    return df.withColumns({"session_id": F.concat_ws("_", "operating_point", "bearing", F.col("measurement").cast("string")), "fs": F.lit(fs)}).drop("name")


def converted_bearings(spark: SparkSession, path: str, most: int = 5, window_s: float = 1.0, current: bool = True, fs: float = 64_000.0) -> DataFrame:
    """Bearing recordings that were converted to Parquet (S10): name (the recording's file name without its ending), vibration, current.

    A name is operating point, bearing and number. Of each bearing and point the first ``most``
    names count; of these the first ``window_s`` seconds, one window a recording. A recording
    whose vibration is missing or shorter is left out, and a shorter current is null.
    Bearings and points outside the fixed tables are left out; if nothing stays, it raises.
    """
    require(spark, path, "convert the bearing recordings to Parquet")
    df = spark.read.parquet(path)
    out = bearing_windows(df.join(bearing_names(df, most), "name"), int(window_s * fs), current, fs)
    if out.isEmpty():
        raise FileNotFoundError(f"{path} has no recording of {window_s} s of a known bearing")
    return out


def bearing_recordings(spark: SparkSession, root: str, most: int = 5, window_s: float = 1.0, current: bool = True, fs: float = 64_000.0) -> DataFrame:
    """Bearing recordings in level-5 containers under root (S10), with the rules of ``converted_bearings``.

    Files are chosen by their names, so that no other is opened, and of a chosen one only the
    channels that are asked for are decoded. A file that can't be decoded is left out; where
    it was one of the first ``most`` names, no other takes its place. If nothing stays, it raises.
    """
    found = binary.files(spark, root, "*.mat").withColumn("name", F.regexp_replace(binary.file_name("path"), r"\.mat$", ""))
    names = bearing_names(found, most)
    chosen = found.join(names, "name").select("path", "content")
    wanted = ["vibration_1", "phase_current_1"] if current else ["vibration_1"]
    read = binary.recordings(chosen, wanted).where("error is null").withColumn("name", F.regexp_replace(binary.file_name("path"), r"\.mat$", ""))
    read = read.join(names, "name").select(*names.columns, F.col("channels")["vibration_1"].alias("vibration"), F.col("channels")["phase_current_1"].alias("current"))
    out = bearing_windows(read, int(window_s * fs), current, fs)
    if out.isEmpty():
        raise FileNotFoundError(f"{root} has no recording of {window_s} s of a known bearing; extract the archives of the bearings there")
    return out


#: What a missing value may be written as, in lower case.
MISSING = ["", "nan", "-nan", "na", "n/a", "#n/a", "null", "none", "<na>"]
TELEMETRY = "file string, pump string, ts timestamp, " + ", ".join(f"{c.replace('.', '_')} double" for c in CHANNELS) + ", problem string, error string"


def _telemetry_table(content: bytes) -> tuple[list[str], pa.Table]:
    """The pumps of a file and its cells as they are written; the header tells the dialect."""
    header = content.split(b"\n", 1)[0]
    sep, decimal = (";", ",") if header.count(b";") > header.count(b",") else (",", ".")
    names = header.decode("utf-8-sig", "replace").strip().split(sep)
    pumps = sorted({c.split("_", 1)[0] for c in names if "_" in c and c.split("_", 1)[1] in CHANNELS})
    missing = [f"{p}_{c}" for p in pumps for c in CHANNELS if f"{p}_{c}" not in names]
    if not pumps or missing:
        raise LookupError(f"lacks channels {missing or CHANNELS}; columns are {names[:4]}")
    used = [names[0], *(f"{p}_{c}" for p in pumps for c in CHANNELS)]
    options = csv.ConvertOptions(column_types=dict.fromkeys(used, pa.string()), include_columns=used, strings_can_be_null=False)
    table = csv.read_csv(pa.BufferReader(content), csv.ReadOptions(column_names=names, skip_rows=1, use_threads=False), csv.ParseOptions(delimiter=sep), options)
    for i, name in enumerate(used[1:], 1):
        text = pc.utf8_trim_whitespace(table[name].combine_chunks())
        text = pc.if_else(pc.is_in(pc.utf8_lower(text), pa.array(MISSING)), pa.scalar(None, pa.string()), text)
        plain = pc.replace_substring(text, ",", ".") if decimal == "," else text
        try:
            values = pc.cast(plain, pa.float64())
        except pa.ArrowInvalid:
            bad = next(t for t in text.to_pylist() if t is not None and not _is_number(t.replace(",", ".") if decimal == "," else t))
            raise ValueError(f"corrupt {name}: {bad}") from None
        table = table.set_column(i, name, values)
    return pumps, table


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return "_" not in text


def telemetry_rows(files: DataFrame) -> DataFrame:
    """Rows of telemetry files in either dialect (path, content), a task a share of the files.

    The dialect is read off the header: more semicolons than commas mean decimal commas. Of a
    good file a row a reading and pump, in order of file; readings without any timestamp, as a
    trailing blank line makes them, go. A file is refused as a whole, as one row with its
    error, if a channel is absent (problem ``channels``), a cell is no number (``cell``) or a
    timestamp doesn't parse (``timestamp``): no row of it is dropped in silence.
    """
    schema = pa.schema([("file", pa.string()), ("pump", pa.string()), ("ts", pa.timestamp("us", "UTC")), *((c.replace(".", "_"), pa.float64()) for c in CHANNELS), ("problem", pa.string()), ("error", pa.string())])

    def read(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        problem = "cell"
        try:
            pumps, table = _telemetry_table(content)
            written = pc.utf8_trim_whitespace(table[table.column_names[0]].combine_chunks())
            blank = pc.is_in(pc.utf8_lower(written), pa.array(MISSING))
            problem = "timestamp"
            ts = pd.to_datetime(pd.Series(pc.filter(written, pc.invert(blank)).to_pylist(), dtype=object), utc=True, format="mixed")
            ts = pa.array(ts.to_numpy("datetime64[us]"), pa.timestamp("us", "UTC"))
        except (LookupError, ValueError, OverflowError) as e:
            problem = "channels" if isinstance(e, LookupError) else problem
            yield pa.RecordBatch.from_pylist([{"file": path, "problem": problem, "error": f"{path} {e}"[:300]}], schema)
            return
        table = table.filter(pc.invert(blank))
        for p in pumps:
            cells = [table[f"{p}_{c}"].combine_chunks() for c in CHANNELS]
            columns = [pa.repeat(path, len(ts)), pa.repeat(p, len(ts)), ts, *cells, pa.nulls(len(ts), pa.string()), pa.nulls(len(ts), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from read(path.as_py(), content.as_py())

    return files.select("path", "content").mapInArrow(run, TELEMETRY)


def telemetry_file(spark: SparkSession, path: str) -> DataFrame:
    """One telemetry file: pump, ts and its channels; a file that ``telemetry_rows`` refuses raises."""
    return telemetry(spark, [path], skip_corrupted=False)


def telemetry(spark: SparkSession, paths: list[str], skip_corrupted: bool = True) -> DataFrame:
    """Telemetry of all files of these paths, folders or globs: pump, ts and its channels.

    One job reads the files and judges them; its rows stay on the executors' disks, so that
    no file is read again. A file with a corrupt cell raises, or is left out with a warning.
    Files without their channels and timestamps that don't parse always raise, as does the
    absence of any good file. For rows and errors without a job, take ``telemetry_rows``.
    """
    for p in paths:
        require(spark, p, "download the telemetry")
    rows = telemetry_rows(spark.read.format("binaryFile").load(paths)).persist(StorageLevel.DISK_ONLY)
    refused_ = rows.where("error is not null")
    shown = refused_.orderBy(F.col("problem") == "cell", "file").limit(20).collect()
    for r in shown:
        if not skip_corrupted or r["problem"] != "cell":
            raise ValueError(r["error"])
        warnings.warn(f"{r['file']} is skipped: {r['error']}", stacklevel=2)
    if len(shown) == 20:
        warnings.warn(f"{refused_.count()} files are skipped", stacklevel=2)
    out = rows.where("error is null").select("pump", "ts", *[c.replace(".", "_") for c in CHANNELS])
    if shown and out.isEmpty():
        raise ValueError("no telemetry file could be read")
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array, or of files of a record each where the path is a glob, with defaults for speed and rate."""
    require(spark, path, "write the demo cache or download the records")
    df = spark.read.json(path, multiLine=True)
    for c, v in (("rpm", 1470.0), ("fs_vib", 20_000.0)):
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in df.columns else F.lit(v))
    return df


#: Payloads of a record and the texts and numbers that it may lack.
PAYLOADS = {"vibration_path": "vibration", "current_path": "current", "current_waveform_path": "current_waveform"}
DEFAULTS = {"severity": "unknown", "session_id": "", "component_id": "", "operating_point": "", "fs_current": 20_000.0}


def records(spark: SparkSession, root: str) -> DataFrame:
    """Records under root with their payloads (S11): an array and its shape for each path that a record names.

    The manifest is root/manifest.json, or else all record_*.json files below root. Payloads are
    array files, decoded in the tasks that read them. A payload that is missing or can't be
    decoded raises; a record that names none has nulls.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")
    if exists(spark, f"{root}/manifest.json"):
        entries = manifest(spark, f"{root}/manifest.json")
    else:
        entries = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "record_*.json").json(root, multiLine=True) if exists(spark, root) else None
        if entries is None or not entries.columns:
            raise FileNotFoundError(f"{root} has no manifest.json and no record_*.json")
        for c, v in (("rpm", 1470.0), ("fs_vib", 20_000.0)):
            entries = entries.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in entries.columns else F.lit(v))
    for c, v in DEFAULTS.items():
        entries = entries.withColumn(c, F.coalesce(F.col(c).cast("string" if isinstance(v, str) else "double"), F.lit(v)) if c in entries.columns else F.lit(v))
    named = [c for c in PAYLOADS if c in entries.columns]
    out = entries
    for c in PAYLOADS:
        if c not in named:
            out = out.withColumns({PAYLOADS[c]: F.lit(None).cast("array<double>"), f"{PAYLOADS[c]}_shape": F.lit(None).cast("array<int>")})
    if not named:
        return out
    paths = entries.select(F.explode(F.array(*named)).alias("p")).where("p is not null").distinct().select(F.concat(F.lit(f"{base}/"), "p").alias("path"))
    read = binary.payloads(binary.files(spark, root, "*.npy").join(paths, "path", "left_semi"))
    for c in named:
        side = read.select(F.substring("path", len(base) + 2, 1 << 30).alias(c), F.col("values").alias(PAYLOADS[c]), F.col("shape").alias(f"{PAYLOADS[c]}_shape"), F.col("error").alias("__error"), F.lit(True).alias("__there"))
        out = out.join(side, c, "left")
        wrong = F.when(F.col("__error").isNotNull(), F.concat(F.col(c), F.lit(": "), "__error")).when(F.col(c).isNotNull() & F.col("__there").isNull(), F.concat(F.col(c), F.lit(" is missing")))
        out = out.withColumn(PAYLOADS[c], F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<double>")).otherwise(F.col(PAYLOADS[c]))).drop("__error", "__there")
    return out


def save_sessions(df: DataFrame, path: str) -> None:
    """Sessions with their waveforms, a folder a session."""
    df.write.mode("append").partitionBy("session_id").parquet(path)


def load_sessions(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    require(spark, path, "collect a session first")
    df = spark.read.parquet(path)
    return df.where(F.col("session_id") == session) if session else df


def save_results(metrics: DataFrame, path: str) -> None:
    """A metrics table as JSON lines; columns that start with _ are left out."""
    metrics.select(*[c for c in metrics.columns if not c.startswith("_")]).coalesce(1).write.mode("overwrite").json(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Results or an error, never made-up numbers."""
    require(spark, path, "run the experiment first")
    return spark.read.json(path)
