"""Folders of files as a Spark sink: each bundle is published whole or not at all.

Rows are files (bundle, name, content). Tasks write them to a stage beside the published bundles; the driver's commit,
which only sees names and digests, moves each bundle by one rename. A write that fails, or a task that is lost, leaves
nothing published; a write that runs again after its commit was cut short finds what is there already equal to its own
and publishes the rest. A published bundle with other contents is never touched, and then nothing of the write is.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..shared import small_batches
from . import tiff
from .raster import _open

FILES = "bundle string, name string, content binary"
#: What names of bundles and files may be: nothing that leads out of their folder, or hides.
NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9._-]{0,199}")
MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """Of one task: its stage and the digests of each bundle's files."""

    stage: str
    bundles: dict[str, dict[str, str]]


def _manifest(files: dict[str, str]) -> bytes:
    return json.dumps(dict(sorted(files.items())), indent=1).encode()


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.run = folder, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        fs, root = _open(self.folder)
        stage, bundles = f"{root}/.stage-{self.run}/{uuid.uuid4().hex}", {}
        for batch in iterator:
            for k in range(batch.num_rows):  # a file at a time
                r = {c: batch.column(c)[k].as_py() for c in ("bundle", "name", "content")}
                if not all(NAME.fullmatch(r[k] or "") for k in ("bundle", "name")) or r["name"] == MANIFEST:
                    raise ValueError(f"not a name of a file: {r['bundle']}/{r['name']}")
                own = bundles.setdefault(r["bundle"], {})
                if r["name"] in own:
                    raise ValueError(f"{r['bundle']}/{r['name']} comes twice")
                own[r["name"]] = hashlib.sha256(r["content"] or b"").hexdigest()
                fs.create_dir(f"{stage}/{r['bundle']}", recursive=True)
                with fs.open_output_stream(f"{stage}/{r['bundle']}/{r['name']}") as f:
                    f.write(r["content"] or b"")
        pa.default_memory_pool().release_unused()  # the worker stays, and would keep it
        for name, files in bundles.items():
            with fs.open_output_stream(f"{stage}/{name}/{MANIFEST}") as f:
                f.write(_manifest(files))
        return Written(stage, bundles)

    def commit(self, messages) -> None:
        fs, root = _open(self.folder)
        fs.create_dir(root, recursive=True)  # there even if nothing is published
        try:
            todo, seen = [], set()
            for m in filter(None, messages):
                for name, files in m.bundles.items():
                    if name in seen:
                        raise ValueError(f"bundle {name} comes from two tasks")
                    seen.add(name)
                    if fs.get_file_info(f"{root}/{name}").type.name == "NotFound":
                        todo.append((m.stage, name))
                        continue
                    known = fs.get_file_info(f"{root}/{name}/{MANIFEST}").type.name == "File"
                    if not known or fs.open_input_file(f"{root}/{name}/{MANIFEST}").read() != _manifest(files):
                        raise FileExistsError(f"bundle {name} is published with other contents")
            for stage, name in todo:
                fs.move(f"{stage}/{name}", f"{root}/{name}")
        finally:
            self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = _open(self.folder)
        if fs.get_file_info(f"{root}/.stage-{self.run}").type.name == "Directory":
            fs.delete_dir(f"{root}/.stage-{self.run}")


class Bundles(DataSource):
    """Option path: the folder of the published bundles. Only appends."""

    @classmethod
    def name(cls):
        return "bundles"

    def schema(self):
        return FILES

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("bundles are never overwritten")
        if [f.name for f in schema] != ["bundle", "name", "content"]:
            raise ValueError(f"rows are {FILES}")
        return BundleWriter(self.options["path"])


def publish(files: DataFrame, folder: str, together: bool = False) -> None:
    """Writes rows of FILES; all files of a bundle go through one task. With together they are in one already, as those of
    window_bundles(), and are written where they are made; a bundle that comes from two tasks is refused."""
    spark = files.sparkSession
    spark.dataSource.register(Bundles)
    with small_batches(spark):
        files = files.select("bundle", "name", "content")
        (files if together else files.repartition("bundle")).write.format("bundles").mode("append").option("path", folder).save()


def published(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of FILES of all published bundles, without their manifests; stages aren't seen."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    part = lambda k: F.try_element_at(F.split("path", "/"), F.lit(k))
    t = t.select(part(-2).alias("bundle"), part(-1).alias("name"), "content", part(-4).alias("_above"))
    return t.where((F.col("name") != MANIFEST) & ~F.coalesce(F.col("_above").startswith(".stage-"), F.lit(False))).drop("_above")


#: Names of the files of a registration's bundle.
IMAGE, TIES, DOSSIER = "registered_output.tif", "tiepoints.csv", "registration_dossier.json"
#: Samples of a window at most; a window is one image in one task.
WINDOW_PIXELS = 1 << 20


def window_bundles(px: DataFrame, rows: DataFrame, height: int, width: int, grid: tuple[float, float, float] | None = None, scale: float = 1.0, value_offset: float = 0.0, columns: tuple[str, ...] = (), dtype: str = "f8", tile: tuple[int, int] | None = None, turn: int | None = None) -> DataFrame:
    """Rows of FILES: for each window of height x width samples its image with an internal mask, its ties and its dossier.

    px: y, x (of the whole scene), v, ok, each once, every sample of a window that has any; rows: wy, wx (number of the
    window), i, line (see ties.tie_records), columns being the names in the first line, and violations, which refuse the
    whole write. grid is the scene's: west, north, step; with turn, a strip longer than the globe is scenes of so many rows
    of windows, one below the other, each with this grid. The image is read again and held against what was meant.
    """
    if not 0 < height * width <= WINDOW_PIXELS:
        raise ValueError(f"a window has {WINDOW_PIXELS} samples at most")
    step = F.floor
    p = px.withColumns({"wy": step(F.col("y") / height).cast("bigint"), "wx": step(F.col("x") / width).cast("bigint")})

    def run(key: tuple, image: pd.DataFrame, ties: pd.DataFrame) -> pd.DataFrame:
        wy, wx = int(key[0]), int(key[1])
        if image.empty:
            raise ValueError(f"ties of window {wy}, {wx}, which has no image")
        if (bad := ties.bad.dropna()).size:
            raise ValueError(f"ties of window {wy}, {wx}: {bad.iloc[0]}")
        y, x = image.y.to_numpy() - wy * height, image.x.to_numpy() - wx * width
        shape = int(y.max()) + 1, int(x.max()) + 1
        if len(image) != shape[0] * shape[1]:
            raise ValueError(f"window {wy}, {wx} has gaps or repeats")
        a, ok = np.zeros(shape, dtype), np.zeros(shape, bool)
        a[y, x], ok[y, x] = np.where(image.ok, image.v, 0), image.ok
        tags = tiff.metadata_tag(1, [scale], [value_offset], None, {"georeferenced": str(grid is not None).lower(), "coordinate_convention": "window; zero-based pixel centres"})
        if grid:
            tags |= tiff.moon_tags(grid[0] + wx * width * grid[2], grid[1] - (wy % turn if turn else wy) * height * grid[2], grid[2])
        raw = tiff.encoded(a, mask=ok, tags=tags, tile=tile)
        back = tiff.opened(raw)
        got, valid = back.window()
        if not (np.array_equal(got[:, :, 0], a) and np.array_equal(valid, ok) and tiff.on_the_moon(back.crs()) == (grid is not None)):
            raise ValueError(f"the image of window {wy}, {wx} reads otherwise")
        lines = ",".join(columns) + "\r\n" + "".join(line + "\r\n" for line in ties.sort_values("i").line)
        said = {
            "schema_version": 2, "window": {"y": wy * height, "x": wx * width, "height": shape[0], "width": shape[1]}, "valid_pixels": int(ok.sum()), "ties": len(ties), "georeferenced": grid is not None,
            "radiometry": "float64 resampled samples; the mask excludes what has no full support", "independent_ground_validation": False, "columns": list(columns),
        }
        files = {IMAGE: raw, TIES: lines.encode(), DOSSIER: json.dumps(said, allow_nan=False, indent=1).encode()}
        return pd.DataFrame({"bundle": f"window-{wy}-{wx}", "name": list(files), "content": list(files.values())})

    g = lambda t, *own: t.select("wy", "wx", *own).groupBy("wy", "wx")
    return g(p, "y", "x", "v", "ok").cogroup(g(rows, "i", "line", F.get("violations", F.lit(0)).alias("bad"))).applyInPandas(run, FILES)


def tile_bundles(requests: DataFrame, extractor: str = "selenite") -> DataFrame:
    """Rows of FILES: for each requested window of a raw raster a bundle `tile-<id>` with its image and its manifest.

    requests: id, path, file_size, file_sha256, label (binary), format, dtype, width, height, offset, prefix, suffix, x, y,
    w, h, band. A task reads no more than the window's rows of samples; a window has WINDOW_PIXELS samples at most.
    """
    import base64

    def one(r) -> list[tuple]:
        dtype = np.dtype(r.dtype)
        if not (0 <= r.x and 0 <= r.y and 0 < r.w <= r.width - r.x and 0 < r.h <= r.height - r.y and r.w * r.h <= WINDOW_PIXELS):
            raise ValueError("the window lies outside of the raster, or is too large")
        stride = r.width * dtype.itemsize + r.prefix + r.suffix
        source, path = _open(r.path)
        a = np.empty((r.h, r.w), dtype)
        with source.open_input_file(path) as f:
            for k in range(r.h):
                f.seek(r.offset + (r.band * r.height + r.y + k) * stride + r.prefix + r.x * dtype.itemsize)
                a[k] = np.frombuffer(f.read(r.w * dtype.itemsize), dtype, r.w)
        a = a.astype(dtype.newbyteorder("="))
        raw = tiff.encoded(a)
        if not np.array_equal(tiff.opened(raw).window()[0][:, :, 0], a, equal_nan=dtype.kind == "f"):
            raise ValueError("the image reads otherwise")
        said = {
            "schema": "tile-1", "original_name": path.rpartition("/")[2], "original_format": r.format, "original_size": int(r.file_size), "original_sha256": r.file_sha256,
            "original_label_base64": base64.b64encode(bytes(r.label)).decode(), "tile_sha256": hashlib.sha256(raw).hexdigest(),
            "tile": {"x": int(r.x), "y": int(r.y), "width": int(r.w), "height": int(r.h), "band": int(r.band)}, "extractor": extractor,
        }
        return [(f"tile-{r.id}", "tile.tif", raw), (f"tile-{r.id}", "tile.json", json.dumps(said).encode())]

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                yield pd.DataFrame(one(r), columns=["bundle", "name", "content"])

    return requests.mapInPandas(run, FILES)
