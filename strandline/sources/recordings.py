"""Recordings: gesture frames and tag streams, spoken digits, archive folders, and options that change a recording."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import series as S
from strandline.sources import vectors


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, line, time, values: white-space frames whose first number is the time; frames of zeros alone are left out. A file is a unit of work."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [[float(v) for v in line.split()] for line in content.decode("utf-8", "replace").splitlines() if line.strip()]
                kept = [(i, r) for i, r in enumerate(rows) if any(r[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kept), pa.string()), pa.array([i for i, _ in kept], pa.int64()), pa.array([r[0] for _, r in kept], pa.float64()), pa.array([r[1:] for _, r in kept], pa.list_(pa.float64()))], names=["path", "line", "time", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, line long, time double, values array<double>")


def read_tags(spark: SparkSession, path: str, ticks: float = 1.0, origin: float = 0.0) -> DataFrame:
    """path, time, label from lines ``ticks;label``; a header without a number goes. Time is (ticks - origin) / ticks per unit."""
    parts = F.split("value", ";")
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.try_to_number(F.trim(parts[0]), F.lit("99999999999999999999")).cast("double").alias("at"), F.trim(F.get(parts, F.lit(1))).alias("label"))
    return lines.filter("at is not null and label is not null").select("path", ((F.col("at") - origin) / ticks).alias("time"), "label")


def name_parts(path: Column, pattern: str, names: list[str]) -> list[Column]:
    """The groups of a pattern over a file's name as columns, such as the speaker and the digit."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    return [F.regexp_extract(base, pattern, i + 1).alias(n) for i, n in enumerate(names)]


def label_samples(labels: DataFrame, samples: DataFrame) -> DataFrame:
    """labels (series, time, label) with t, the first sample (series, time, t) at or after its time."""
    return S.asof_forward(labels, samples)


def segments(df: DataFrame, label: str, shortest: int = 1) -> DataFrame:
    """series, start, end, label of the stretches with one label."""
    return S.runs(df, label).withColumnRenamed("value", "label").filter(F.col("end") - F.col("start") >= shortest)


def first_of_each(annotations: DataFrame, n: int, *labels: str) -> DataFrame:
    """The annotations, of the named labels only the first ``n`` in each series."""
    r = F.row_number().over(Window.partitionBy("series", "label").orderBy("start"))
    return annotations.withColumn("_r", r).filter(~F.col("label").isin(*labels) | (F.col("_r") <= n)).drop("_r")


def noisy(df: DataFrame, scale: float, seed: int = 0, x: str = "x") -> DataFrame:
    return df.withColumn(x, F.col(x) + F.randn(seed) * scale)


def check_annotations(df: DataFrame, longest: int = 250) -> DataFrame:
    """problem, n: annotations of impossible length, ends that fall behind the end before them, and labels that are missing."""
    w = Window.partitionBy("series").orderBy("start")
    ordered = df.withColumn("_before", F.lag("end").over(w))
    length = F.col("end") - F.col("start")
    tests = {"length": (length <= 0) | (length >= longest), "order": F.coalesce(F.col("end") < F.col("_before"), F.lit(False)), "label": F.col("label").isNull() | (F.col("label") == "")}
    counts = ordered.agg(*(F.count_if(t).alias(n) for n, t in tests.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("problem"), F.col(n).alias("n")) for n in tests))).alias("s")).select("s.*")


def read_audio(spark: SparkSession, path: str, rate: int = 20_000) -> DataFrame:
    """path, rate, samples (-1 to 1) of WAVE files, or of headerless 16-bit little-endian sound at ``rate``; channels are averaged."""

    def decode(content: bytes) -> tuple[int, np.ndarray]:
        if content[:4] != b"RIFF":
            return rate, np.frombuffer(content[: len(content) // 2 * 2], "<i2") / 32768
        with wave.open(io.BytesIO(content)) as w:
            width, raw = w.getsampwidth(), w.readframes(w.getnframes())
            if width == 1:
                x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
            elif width == 2:
                x = np.frombuffer(raw, "<i2") / 32768
            else:
                raise ValueError(f"samples of {width} bytes")
            return w.getframerate(), x.reshape(-1, w.getnchannels()).mean(1)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                r, x = decode(content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([r], pa.int32()), pa.array([x.tolist()], pa.list_(pa.float64()))], names=["path", "rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, rate int, samples array<double>")


def utterance(power: Column, share: float = 0.1) -> Column:
    """(start, end) of the frames whose power is above the least by more than a share of the range."""
    cut = F.array_min(power) + share * (F.array_max(power) - F.array_min(power))
    loud = F.filter(F.transform(power, lambda p, i: F.when(p > cut, i)), lambda i: i.isNotNull())
    return F.struct(F.array_min(loud).alias("start"), (F.array_max(loud) + 1).alias("end"))


def spectrogram(x: np.ndarray, window: int, step: int) -> np.ndarray:
    """Magnitudes of the Fourier transform of Hann-windowed frames: frames x frequencies."""
    if len(x) < window:
        x = np.pad(x, (0, window - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::step]
    return np.abs(np.fft.rfft(frames * np.hanning(window), axis=1))


def mel_weights(bands: int, window: int, rate: float) -> np.ndarray:
    """Triangles, equally spaced in mel, over the frequencies of a spectrogram."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, window // 2 + 1)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def cepstra(x: np.ndarray, rate: float, window: int, step: int, bands: int = 26, count: int = 13) -> np.ndarray:
    """Mel-frequency cepstral coefficients: the cosine transform (orthonormal) of the logarithm of power in the bands."""
    power = np.log(np.maximum(spectrogram(x, window, step) ** 2 @ mel_weights(bands, window, rate).T, 1e-10))
    n = np.arange(bands)
    basis = np.cos(np.pi / bands * (n + 0.5) * np.arange(count)[:, None]) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return power @ basis.T


def audio_features(sound: DataFrame, kind: str = "mfcc", window: int = 512, step: int = 256, bands: int = 26, count: int = 13) -> DataFrame:
    """path, frame, features of rows (path, rate, samples): ``mfcc``, ``stft``, ``log_stft``, ``bands`` or ``log_bands``. A recording is a unit of work."""

    def features(x: np.ndarray, rate: int) -> np.ndarray:
        if kind == "mfcc":
            return cepstra(x, rate, window, step, bands, count)
        s = spectrogram(x, window, step)
        s = s**2 @ mel_weights(bands, window, rate).T if kind.endswith("bands") else s
        return np.log(np.maximum(s, 1e-10)) if kind.startswith("log") else s

    if kind not in ("mfcc", "stft", "log_stft", "bands", "log_bands"):
        raise ValueError("mfcc, stft, log_stft, bands or log_bands")

    def run(batches):
        for b in batches:
            for name, rate, x in zip(b.column("path").to_pylist(), b.column("rate").to_pylist(), b.column("samples").to_pylist(), strict=True):
                f = features(np.array(x, float), rate)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(f)), pa.array(np.arange(len(f))), pa.array(f.tolist(), pa.list_(pa.float64()))], names=["path", "frame", "features"])

    return sound.select("path", "rate", "samples").filter("samples is not null").mapInArrow(run, "path string, frame long, features array<double>")


def decimated(x: np.ndarray, by: int, taps: int = 20) -> np.ndarray:
    """Every ``by``-th value after a low-pass filter (a windowed sinc of 2 * taps * by + 1 weights), with the ends held."""
    if by <= 1:
        return x
    n = np.arange(-taps * by, taps * by + 1)
    weights = np.sinc(n / by) * np.hamming(len(n))
    held = np.pad(x, taps * by, mode="edge")
    return np.convolve(held, weights / weights.sum(), "valid")[::by]


def decimate(df: DataFrame, by: int, values: str = "values") -> DataFrame:
    """``df`` with each of its arrays low-passed and decimated."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else decimated(np.asarray(v, float), by).tolist())

    return df.withColumn(values, run(F.col(values).cast("array<double>")))


def read_archive(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """train and test of an archive folder: ``<root>/<name>/<name>_TRAIN`` and ``_TEST``."""
    return {part.lower(): vectors.read_labelled_series(spark, f"{root}/{name}/{name}_{part}") for part in ("TRAIN", "TEST")}


def archive_sets(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """name, bytes of the sets below an archive's root, from their training files; on request only those of at most ``most`` bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*_TRAIN").option("recursiveFileLookup", True).load(root).select("path", "length")
    sets = found.select(F.regexp_extract("path", r"([^/]+)_TRAIN$", 1).alias("name"), F.col("length").alias("bytes"))
    return sets if most is None else sets.filter(F.col("bytes") <= most)


def labelled_series(spark: SparkSession, root: str, name: str, per_series: int = 0) -> DataFrame:
    """series, label, values of an archive set's training part; on request ``per_series`` instances of a label joined to one longer series each."""
    rows = read_archive(spark, root, name)["train"]
    if not per_series:
        return rows
    number = F.row_number().over(Window.partitionBy("label").orderBy("series")) - 1
    grouped = rows.withColumn("part", F.floor(number / per_series)).groupBy("label", "part")
    joined = grouped.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("series", "values"))), lambda s: s["values"])).alias("values"))
    return joined.select(F.concat_ws("-", "label", "part").alias("series"), "label", "values")


def archive_size(series: DataFrame) -> DataFrame:
    """n, length, elements: what decides whether a set counts as small or tiny."""
    return series.agg(F.count("*").alias("n"), F.max(F.size("values")).alias("length"), F.sum(F.size("values")).alias("elements"))


def instances(series: DataFrame, fewest: int = 1, most: int | None = None) -> DataFrame:
    """The series of labels that occur often enough, at most ``most`` of each on request (a limit that the caller states)."""
    often = series.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest).select("label")
    kept = series.join(often, "label", "left_semi")
    return kept if most is None else kept.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("series"))).filter(F.col("_r") <= most).drop("_r")


def prepared(data: DataFrame, rows: int | None = None, dims: int | None = None, centre_on: DataFrame | None = None, unit: bool = False, multiple: int = 1) -> DataFrame:
    """A set of vectors cut to the first rows (by vec_id) and dimensions, less the means of ``centre_on``, of length 1, and padded, each on request."""
    from strandline.functions import arrays
    from strandline.operators import linear

    e = F.col("embedding").cast("array<double>")
    out = data.orderBy("vec_id").limit(rows) if rows is not None else data
    out = out.withColumn("embedding", F.slice(e, 1, dims) if dims is not None else e)
    if centre_on is not None:
        mean = linear.covariance_matrix(centre_on)[0][:dims]
        out = out.withColumn("embedding", F.zip_with("embedding", F.array(*(F.lit(float(v)) for v in mean)), lambda x, m: x - m))
    out = out.withColumn("embedding", arrays.normalize(F.col("embedding"), "l2")) if unit else out
    return out.withColumn("embedding", arrays.pad_columns(F.col("embedding"), multiple)) if multiple > 1 else out


def warping_path(n: int, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Positions 0 to n - 1 that never go back and start and end where they would unwarped."""
    steps = np.exp(strength * rng.normal(size=max(n - 1, 1)))
    path = np.concatenate([[0], np.cumsum(steps)])[:n]
    return path / max(path[-1], 1e-12) * (n - 1)


def warped(x: np.ndarray, strength: float, rng: np.random.Generator) -> np.ndarray:
    return np.interp(warping_path(len(x), strength, rng), np.arange(len(x)), x)


def phases_shuffled(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A series with the same spectrum and random phases."""
    f = np.fft.rfft(x)
    turned = np.abs(f) * np.exp(2j * np.pi * rng.random(len(f)))
    turned[0] = f[0]
    return np.fft.irfft(turned, len(x))


def band_passed_walk(n: int, low: float, high: float, rng: np.random.Generator) -> np.ndarray:
    """A random walk of which frequencies (in cycles a sample) between two bounds are left."""
    f = np.fft.rfft(np.cumsum(rng.normal(size=n)))
    at = np.fft.rfftfreq(n)
    return np.fft.irfft(np.where((at >= low) & (at <= high), f, 0), n)


def planted_dims(kinds: list[str], length: int, instance: int, starts: list[int], noise_dims: int = 0, noise: float = 0.05, seed: int = 0) -> np.ndarray:
    """dimensions x length: one dimension for each kind of shape, planted at the same places, and others of noise alone."""
    rng = np.random.default_rng(seed)
    rows = [vectors.planted_series(k, length, instance, starts, noise, seed + i) for i, k in enumerate(kinds)]
    return np.stack(rows + [rng.normal(scale=1.0, size=length) for _ in range(noise_dims)])
