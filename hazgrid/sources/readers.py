"""Sources: typed tables, streams of tables, ASCII PLY clouds, and parameter files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazgrid.functions.parameters import KEYS, Parameters

KEYFRAMES = "map_id long, kf_id long, kind string, ts_ns long, seq long, has_cloud boolean, qw double, qx double, qy double, qz double, tx double, ty double, tz double"
POINTS = "kf_id long, x double, y double, z double"
POSE_UPDATES = "kf_id long, seq long, qw double, qx double, qy double, qz double, tx double, ty double, tz double"
CLOUDS = "source long, t long, seq long, x double, y double, z double"
UPDATES = "map_id long, seq long, is_full boolean, resolution double, origin_x double, origin_y double, layers array<string>, cell_keys array<long>, values array<float>"


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table. With a schema no footer is read to infer one."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def ply(spark: SparkSession, path: str, kf_id: int = 0) -> DataFrame:
    """Points of an ASCII PLY file as one keyframe's.

    Only the header reaches the driver. Vertices are the lines of numbers, as many as the vertex has properties; a file
    whose faces (a count and that many indexes) could be taken for vertices is refused.
    """
    lines = spark.read.text(path)
    names, inside, faces = [], False, False
    for (line,) in lines.limit(200).toLocalIterator():
        word = line.split()
        if word[:1] == ["element"]:
            inside = word[1] == "vertex"
            faces |= not inside and int(word[2]) > 0
        elif word[:1] == ["property"] and inside:
            names.append(word[-1])
        elif word[:1] == ["format"] and word[1] != "ascii":
            raise ValueError("only ASCII PLY files can be read")
        elif word == ["end_header"]:
            break
    else:
        raise ValueError("no PLY header in the first lines")
    if faces and len(names) in (4, 5):
        raise ValueError("faces can't be told from vertices with so many properties")
    if not {"x", "y", "z"} <= set(names):
        raise ValueError("the vertices have no x, y and z")
    numbers = F.split(F.trim("value"), r"\s+")
    body = lines.where(F.trim("value").rlike(r"^[-+0-9.eEnaifNIF\s]+$")).withColumn("v", numbers).where(F.size("v") == len(names))
    return body.select(F.lit(kf_id).cast("long").alias("kf_id"), *[F.expr(f"try_cast(v[{names.index(c)}] as double)").alias(c) for c in "xyz"])


def parameters(path: str) -> Parameters:
    """A YAML file with all 22 keys, nested or joined by slashes."""
    import yaml

    with open(path, encoding="utf-8") as f:
        spec = yaml.safe_load(f) or {}
    flat: dict = {}

    def walk(node: dict, above: str) -> None:
        for k, v in node.items():
            if isinstance(v, dict):
                walk(v, f"{above}{k}/")
            else:
                flat[f"{above}{k}"] = v

    walk(spec, "")
    missing = set(KEYS) - set(flat)
    if missing:
        raise KeyError(f"missing parameters: {', '.join(sorted(missing))}")
    return Parameters().with_values({k: flat[k] for k in KEYS})
