"""Files by kind: JSON, JSON lines, Parquet lists, COCO documents, archives, arrays; and a registry of named readers."""

from __future__ import annotations

import codecs
import io
import os
import pickle
import re
import tarfile
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.functions import masks, rasters
from prismloom.plans.shipping import ship

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "gif", "webp", "tif", "tiff")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .jsonl lines, .json documents, .parquet, .csv, anything else as text lines."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    read = {"jsonl": spark.read.json, "json": lambda p: spark.read.json(p, multiLine=True), "parquet": spark.read.parquet, "csv": lambda p: spark.read.csv(p, header=True, inferSchema=True)}
    return read.get(suffix, spark.read.text)(path)


def expanded(path: str) -> list[str]:
    """Paths of a numeric range in braces: part-{000..002}.parquet."""
    found = re.search(r"\{(\d+)\.\.(\d+)\}", path)
    if not found:
        return [path]
    low, high = found.groups()
    return [p for k in range(int(low), int(high) + 1) for p in expanded(path[: found.start()] + str(k).zfill(len(low)) + path[found.end() :])]


def read_parquet_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(*expanded(path))


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """path, length of a folder's files with these suffixes, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*suffixes)).orderBy("path")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width and height of the images that Spark's image source can read."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))


def repeated(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__epoch")


def coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations with their image's fields; ids must be unique, images without annotations drop out."""
    doc = spark.read.json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    boxes = doc.select(F.explode("annotations").alias("a")).select("a.*")
    twice = boxes.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"annotation id {twice[0]['id']} is not unique")
    x, y, w, h = (F.col("bbox")[k] for k in range(4))
    return boxes.join(images, "image_id").withColumns({"x1": x, "y1": y, "x2": x + w, "y2": y + h})


def panoptic_truth(doc: DataFrame) -> DataFrame:
    """image_id, obj_idx, category_id and box of images(image_id, segments_info, annotations), matched by position."""
    pairs = F.arrays_zip("segments_info", "annotations")
    each = doc.select("image_id", F.posexplode(pairs).alias("obj_idx", "p"))
    return each.select("image_id", "obj_idx", F.col("p.segments_info.category_id").alias("category_id"), *[F.col("p.annotations.bbox")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, content of the regular files in TAR archives; an archive is read by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile():
                            yield pd.DataFrame({"archive": [archive], "name": [member.name], "content": [tar.extractfile(member).read()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, content binary")


def array_pixels(spark: SparkSession, path: str) -> DataFrame:
    """image_id, y, x, value of two-dimensional .npy files, and mask of three-dimensional ones (masks x height x width)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                if data.ndim not in (2, 3):
                    raise ValueError(f"{name}: {data.ndim} dimensions")
                for mask, plane in enumerate(data[None] if data.ndim == 2 else data):
                    y, x = np.nonzero(np.ones_like(plane)) if data.ndim == 2 else np.nonzero(plane)
                    yield pd.DataFrame({"image_id": name.rsplit("/", 1)[-1].split(".")[0], "mask": mask, "y": y, "x": x, "value": plane[y, x].astype(int)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(run, "image_id string, mask int, y int, x int, value int")


def label_mask(masks: DataFrame) -> DataFrame:
    """image_id, y, x, obj_idx: of several masks over a pixel the last one counts."""
    return masks.groupBy("image_id", "y", "x").agg(F.max("mask").alias("obj_idx"))


#: Bytes of pickles that are held as Python's objects at once.
READ = 1 << 22


def _csr_lists(content: bytes) -> list[dict]:
    """The masks of a pickled list of sparse matrices. Only the names below are looked up, none of which runs code of the file."""
    return _masks_of(_matrices(content)).to_pylist()


def _matrices(content: bytes) -> list[_Matrix]:
    return _MatrixReader(io.BufferedReader(io.BytesIO(content))).load()  # buffered, as else each step of the pickle is a read of its own


class SparseMatrix:
    """What a pickle says of a sparse matrix of rows: its shape, the ends of its rows, its columns."""

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)


class _Matrix:
    """A SparseMatrix as it is read: its fields are filled without a call of Python."""


def _masks_of(matrices: list[_Matrix]) -> pa.Array:
    fields = [m.__dict__ for m in matrices]
    return masks.of_csr(
        [np.asarray(m["indptr"]) for m in fields],
        [np.asarray(m["indices"]) for m in fields],
        [None if (data := m.get("data")) is None else np.asarray(data) for m in fields],
        [m.get("_shape") or m["shape"] for m in fields],
    )


class _MatrixReader(pickle.Unpickler):
    """A pickle of numpy arrays and sparse matrices of rows; anything else in it is an error."""

    def find_class(self, module: str, name: str):
        return _named(module, name)


@lru_cache(100)
def _named(module: str, name: str):
    if module.startswith("scipy.sparse") and name in ("csr_matrix", "csr_array"):
        return _Matrix
    if module.startswith("numpy") and name in ("ndarray", "dtype", "_reconstruct", "_frombuffer", "scalar"):
        place = {"ndarray": np, "dtype": np, "_frombuffer": np._core.numeric}.get(name, np._core.multiarray)
        return getattr(place, name)
    if (module, name) == ("_codecs", "encode"):
        return codecs.encode
    raise pickle.UnpicklingError(f"{module}.{name} isn't read from pickled masks")


def _planes(content: bytes) -> list[np.ndarray]:
    data = np.load(io.BytesIO(content), allow_pickle=False)
    if data.ndim not in (2, 3):
        raise ValueError(f"an array of {data.ndim} dimensions is no mask")
    return list(data[None] if data.ndim == 2 else data)


def csr_masks(lists: DataFrame) -> DataFrame:
    """image_id, mask_no and run-length mask of lists(image_id, content), whose content is a pickled list of sparse matrices."""
    ship(lists.sparkSession)

    @F.arrow_udf(f"array<{masks.MASK}>")
    def read(content: pa.Array) -> pa.Array:
        parts, ends = [pa.array([], masks._ARROW)], [np.zeros(1, np.int64)]
        for a, b in masks.in_parts(pc.fill_null(pc.binary_length(content), 0).to_numpy(zero_copy_only=False), READ):
            lists = [_matrices(c) if c is not None else [] for c in content[a:b].to_pylist()]
            parts.append(_masks_of([m for each in lists for m in each]))
            ends.append(ends[-1][-1] + masks.ends_of([len(each) for each in lists])[1:])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.concat_arrays(parts), mask=pc.is_null(content))

    # first read, then exploded: what wrote the lists and what reads them again are one step of Python where nothing lies between
    return lists.select("image_id", read("content").alias("masks")).select("image_id", F.posexplode("masks").alias("mask_no", "mask"))


def mask_lists(spark: SparkSession, path: str) -> DataFrame:
    """image_id, mask_no and run-length mask of the files in a folder: pickled lists of sparse matrices (.pkl) and arrays of masks (.npy).

    A file that holds anything else is an error. Empty masks are rows too.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = _csr_lists(content) if name.endswith(".pkl") else [masks.from_array(plane) for plane in _planes(content)]
                image = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows = [{"image_id": image, "mask_no": k, "mask": m} for k, m in enumerate(found)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("image_id", pa.string()), ("mask_no", pa.int32()), ("mask", masks._ARROW)]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pkl,npy}").load(path).select("path", "content")
    return files.mapInArrow(run, f"image_id string, mask_no int, mask {masks.MASK}")


def array_maps(spark: SparkSession, path: str, scaled: bool = False) -> DataFrame:
    """image_id and packed map of two-dimensional .npy files; scaled, their values go from 0 (the least) to 255 (the greatest)."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                plane = np.load(io.BytesIO(content), allow_pickle=False)
                if plane.ndim != 2:
                    raise ValueError(f"{name}: {plane.ndim} dimensions")
                if scaled:
                    low, high = (float(plane.min()), float(plane.max())) if plane.size else (0.0, 0.0)
                    plane = ((plane.astype(float) - low) / (high - low or 1.0) * 255).astype(np.uint8)
                row = {"image_id": name.rsplit("/", 1)[-1].rsplit(".", 1)[0], "map": rasters.map_of(plane.astype(np.int64))}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("image_id", pa.string()), ("map", pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())]))]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(run, f"image_id string, map {rasters.MAP}")


# Named readers

_READERS: dict[str, Callable[..., DataFrame]] = {"json": read_any, "jsonl": read_any, "parquet": read_parquet_list, "coco": coco}


def register_reader(kind: str, reader: Callable[..., DataFrame]) -> None:
    _READERS[kind] = reader


def with_environment(config, variables: Mapping[str, str] = os.environ):
    """$VAR and ${VAR} in all strings of nested lists and dicts, by the environment or other variables; unknown ones stay."""
    if isinstance(config, dict):
        return {k: with_environment(v, variables) for k, v in config.items()}
    if isinstance(config, list):
        return [with_environment(v, variables) for v in config]
    known = lambda m: variables.get(m[1] or m[2], m[0])
    return re.sub(r"\$(?:(\w+)|\{([^}]*)\})", known, config) if isinstance(config, str) else config


def read_mix(spark: SparkSession, configs: list[dict], variables: Mapping[str, str] = os.environ) -> DataFrame:
    """All datasets of configs ({"type", "path", "name"}), tagged with their name as source; see with_environment for variables."""
    parts = []
    for c in with_environment(configs, variables):
        if c["type"] not in _READERS:
            raise ValueError(f"no reader of type {c['type']!r}; there are {sorted(_READERS)}")
        parts.append(_READERS[c["type"]](spark, c["path"]).withColumn("source", F.lit(c.get("name", c["type"]))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
