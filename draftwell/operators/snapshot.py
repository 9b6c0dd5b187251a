"""Snapshots and their fingerprints."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import ExecutionConfig
from .profile import bounding_box


MANIFEST = "snapshot_id string, unit string, origin string, config string, context string, has_selection boolean"
SELECTION = "kind string, persistent_id_path array<bigint>, instance_path array<string>, layer string"


def transform_context(facts: dict | None) -> dict:
    """The facts of an open container that a rebuild needs, or the mark of the identity where there are none or they are broken.

    A forward and an inverse transform are sixteen finite floats, the completeness of the path a boolean or missing, and the path
    a list of whole numbers, texts and gaps; what else there is travels unchanged.
    """
    known = {str(k): v for k, v in facts.items()} if isinstance(facts, dict) else {}
    sixteen = lambda m: isinstance(m, (list, tuple)) and len(m) == 16 and all(isinstance(v, float) and math.isfinite(v) for v in m)
    slot = lambda p: p is None or isinstance(p, str) or (isinstance(p, int) and not isinstance(p, bool))
    path = known.get("active_edit_path", [])
    sound = (
        all(sixteen(known[k]) for k in ("active_edit_transform", "active_edit_inverse") if k in known)
        and (known.get("pid_path_complete") is None or isinstance(known["pid_path_complete"], bool))
        and isinstance(path, (list, tuple)) and all(slot(p) for p in path)
    )
    return known if known and sound else {"active_edit_seed": "identity"}


@dataclass(frozen=True)
class SourceSnapshot:
    """Immutable source of a workspace: frames are never changed, only written and read as versions."""

    edges: DataFrame
    faces: DataFrame
    layers: DataFrame
    config: ExecutionConfig
    unit: str = "inches"
    origin: str = "raw"
    selection: DataFrame | None = None
    context: dict = field(default_factory=lambda: transform_context(None))

    @property
    def snapshot_id(self) -> str:
        """Content hash, so that equal sources have equal ids; a selection and an open container are part of it."""
        row = source_fingerprint(self.edges, self.faces, self.layers).first()
        name = f"snap-{row.digest[:16]}-{self.config.digest()[:8]}"
        more = [] if self.context == transform_context(None) else [json.dumps(self.context, sort_keys=True)]
        if self.selection is not None:
            more.append(selection_digest(self.selection).first().digest)
        return f"{name}-{hashlib.sha256('|'.join(more).encode()).hexdigest()[:8]}" if more else name

    def write(self, path: str) -> None:
        """Frames, and last a manifest of one row that names the settings; without it there is no snapshot to read."""
        for name in ("edges", "faces", "layers"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        if self.selection is not None:
            self.selection.write.mode("overwrite").parquet(f"{path}/selection")
        spark = self.edges.sparkSession
        row = [(self.snapshot_id, self.unit, self.origin, json.dumps(asdict(self.config), sort_keys=True), json.dumps(self.context, sort_keys=True), self.selection is not None)]
        spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SourceSnapshot:
        """The snapshot as it was written; raises if what is stored no longer has the identity of the manifest."""
        row = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").first()
        frames = [spark.read.parquet(f"{path}/{name}") for name in ("edges", "faces", "layers")]
        selection = spark.read.schema(SELECTION).parquet(f"{path}/selection") if row["has_selection"] else None
        # manifests of former versions have neither a context nor a selection
        found = cls(*frames, ExecutionConfig(**json.loads(row["config"])), row["unit"], row["origin"], selection, json.loads(row["context"]) if row["context"] else transform_context(None))
        if found.snapshot_id != row["snapshot_id"]:
            raise ValueError(f"the snapshot under {path} has changed since it was written")
        return found


def _micros(c) -> F.Column:
    """Billionths as an integer: sums of these don't hang on the order of the rows."""
    return F.round(c * 1e9).cast("decimal(38,0)")


def digest_of(lines, name: str = "digest"):
    """SHA-256 of a set of row digests, by sums of four words: order-free, and no group of rows is gathered."""
    words = [F.sum(F.conv(F.substring(lines, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *[F.coalesce(w, F.lit(0)).cast("string") for w in words]), 256).alias(name)


def selection_scope(occurrences: DataFrame) -> DataFrame:
    """What is selected, one row an occurrence: ``kind, persistent_id_path, instance_path, layer``."""
    return occurrences.select(F.coalesce("kind", F.lit("unknown")).alias("kind"), F.col("path").alias("persistent_id_path"), F.col("labels").alias("instance_path"), "layer")


def selection_digest(scope: DataFrame) -> DataFrame:
    """``entries, digest`` of a selection, which may be as large as the source: sums of row digests, no sorted text of all rows.

    Nothing selected has the empty digest. Null paths and layers count as empty; repeated entries count as often as they are there.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat_ws("|", text(F.col("kind")), text(F.array_join(F.col("persistent_id_path").cast("array<string>"), "/")), text(F.array_join("instance_path", ">")), text(F.col("layer")))
    row = scope.select(F.sha2(line, 256).alias("line")).agg(F.count(F.lit(1)).alias("entries"), digest_of(F.col("line")))
    return row.withColumn("digest", F.when(F.col("entries") > 0, F.col("digest")).otherwise(""))


def material_digest(materials: DataFrame) -> DataFrame:
    """One row with the ``digest`` of the sorted names in the column ``name``, one a line; without materials it is empty.

    Materials are a catalogue, like layers: their names are bounded by what a host lists, not by the geometry.
    """
    names = F.sort_array(F.collect_list(F.coalesce("name", F.lit(""))))
    return materials.agg(F.when(F.count(F.lit(1)) > 0, F.sha2(F.array_join(names, "\n"), 256)).otherwise("").alias("digest"))


def source_fingerprint(edges: DataFrame, faces: DataFrame, layers: DataFrame) -> DataFrame:
    """One row: counts, length, extents and the digest over them and the layers' facts."""
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"), (F.coalesce(F.sum(_micros(F.col("length"))), F.lit(0)).cast("decimal(38,0)")).cast("bigint").alias("edge_length_sum_e9"))
    f = faces.agg(F.count(F.lit(1)).alias("face_count"), F.coalesce(F.sum("outer_loop_vertex_count"), F.lit(0)).cast("bigint").alias("face_vertex_count_sum"))
    facts = F.concat_ws("|", "name", F.col("visible").cast("string"), F.col("edge_count").cast("string"), F.col("face_count").cast("string"))
    by_layer = layers.agg(F.count(F.lit(1)).alias("layer_count"), F.sha2(F.array_join(F.array_sort(F.collect_list(facts)), "\n"), 256).alias("layer_digest"))
    box = bounding_box(edges).select(*[F.round(F.col(f"{m}_{c}") * 1e6).cast("bigint").alias(f"{m}_{c}_e6") for m in ("min", "max") for c in "xyz"])
    row = e.crossJoin(f).crossJoin(by_layer).crossJoin(box)  # single rows
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("nil")) for c in row.columns])
    return row.withColumn("digest", F.sha2(text, 256))


def derived_digest(derived: DataFrame) -> DataFrame:
    """Adds ``digest`` of each derived row; host handles take no part in it."""
    spots = [F.round(F.col(c) * 1e6).cast("bigint").cast("string") for c in ("sx", "sy", "sz", "ex", "ey", "ez")]
    text = F.concat_ws("|", "derived_id", "kind", F.array_join(F.array_sort("source_occurrence_ids"), ","), *spots, "layer", F.coalesce("parent_derived_id", F.lit("")))
    return derived.withColumn("digest", F.sha2(text, 256))


def workspace_fingerprint(derived: DataFrame, config_digest: str = "") -> DataFrame:
    """One row: entity count, count by kind, and a digest over all rows' digests."""
    rows = derived_digest(derived)
    row = rows.agg(F.count(F.lit(1)).alias("entity_count"), F.count_if(F.col("kind") == "edge").alias("edge_entities"), digest_of(F.col("digest"), "entities_digest"))
    return row.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.lit(config_digest), F.col("entity_count").cast("string"), "entities_digest"), 256))


def workspace_relations(derived: DataFrame) -> DataFrame:
    """``kind, entities, with_parent, parents_digest``: entities by kind and a digest of who is whose parent (empty for none)."""
    pair = F.sha2(F.concat_ws("|", F.coalesce("derived_id", F.lit("")), F.coalesce("parent_derived_id", F.lit(""))), 256)
    rows = derived.select("kind", F.col("parent_derived_id").isNotNull().alias("has"), pair.alias("pair"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("entities"), F.count_if("has").alias("with_parent"), digest_of(F.col("pair"), "parents_digest"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, as often."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
