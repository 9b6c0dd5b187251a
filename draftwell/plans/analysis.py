"""The whole analysis as one plan: snapshot, profile, detection, issues, groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..config import AnalysisConfig
from ..operators import detectors, issues as iss, profile
from ..operators.sift import sifted
from ..operators.vertices import Spots, vertices
from ..session import stored


@dataclass
class Analysis:
    """Frames of one analysis. Vertices are written once and shared by the detectors that need them."""

    edges: DataFrame
    faces: DataFrame
    layers: DataFrame
    containers: DataFrame
    config: AnalysisConfig = field(default_factory=AnalysisConfig)
    diagnostics: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._vertices: DataFrame | None = None
        self._spots: Spots | None = None
        self._issues: DataFrame | None = None
        self._duplicates: DataFrame | None = None
        self._met: tuple[DataFrame, int] | None = None

    @property
    def spots(self) -> Spots:
        if self._spots is None:
            self._spots = Spots.of(self.edges, self.config.tolerance.coordinate_epsilon)
        return self._spots

    @property
    def vertices(self) -> DataFrame:
        if self._vertices is None:
            self._vertices = vertices(self.edges, self.config.tolerance.coordinate_epsilon, found=self.spots)  # its positions are stored
        return self._vertices

    def raw_issues(self) -> DataFrame:
        """The four detectors' issues in one frame."""
        t = self.config.tolerance
        parts = [
            detectors.duplicate_edges(self.edges, t.duplicate), detectors.short_edges(self.edges, t.short_edge), detectors.open_endpoints(self.vertices),
            detectors.gap_candidates(self.vertices, t.gap_search),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def warnings(self) -> DataFrame:
        t = self.config.tolerance
        z = profile.z_vertices(self.edges, t.coordinate_epsilon, t.big_z, self.spots)
        return profile.warnings(z, profile.large_extrema(self.edges, t.large_coordinate), self.containers.select("deepest_nesting"), self.config)

    def normalized(self) -> DataFrame:
        return iss.normalized(self.raw_issues()).unionByName(iss.warnings_as_issues(self.warnings()))

    def _found(self) -> tuple[DataFrame, int]:
        """Issues with the edges that they met, spare: what can be said of type and numbers is added where they have arrived. And how many."""
        if self._met is None:
            t = self.config.tolerance
            out = detectors.duplicate(self.edges, t.duplicate)
            for part in (detectors.short(self.edges, t.short_edge), detectors.open_ends(self.vertices), detectors.gaps(self.vertices, t.gap_search), detectors.told(self.warnings())):
                out = out.unionByName(part)
            self._met = self._meet(out, self.edges)
        return self._met

    def _meet(self, spare: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, int]:
        """Spare issues with the edges that they met, and how many; without ``edges`` those that an issue names are taken."""
        spare = stored(spare.withColumn("__iid", F.monotonically_increasing_id()))
        if edges is None:
            edges = stored(sifted(self.edges, "edge_id", stored(spare.select(F.explode("edge_ids").alias("edge_id")))))
        return iss.met(spare, edges).drop("__iid"), spare.count()

    def _described(self, found: DataFrame) -> DataFrame:
        more = [F.col(c).alias(f"__{c}") for c in found.columns if c == "counter"]
        rows = iss.normalized(self._dressed(found.select("*", *more)))
        return iss.described(iss.resolved(rows), self.config.tolerance.coordinate_epsilon)

    def _dressed(self, found: DataFrame) -> DataFrame:
        t = self.config.tolerance
        return detectors.dressed(found, t.short_edge, t.duplicate, t.gap_search)

    @property
    def sourced(self) -> DataFrame:
        return self._described(self._found()[0])

    @property
    def counted(self) -> DataFrame:
        """The accepted issues for counts by type, layer or severity: without positions, so nothing is sorted."""
        return iss.registry(iss.with_display(self.sourced.withColumn("issue_id", F.concat_ws("|", "issue_type", "source_keys"))))[0]

    @property
    def issues(self) -> DataFrame:
        """Issues with sources and ids that the registry accepts."""
        if self._issues is None:
            self._issues = self._identified(*self._found())
        return self._issues

    @property
    def duplicates(self) -> DataFrame:
        """The rows of :attr:`issues` about edges that coincide. Issues are counted within their type, so what other detectors find bears
        on no identifier and need not be found."""
        if self._issues is not None:
            return self._issues.where("issue_type = 'duplicate_edge_candidate'")
        if self._duplicates is None:
            self._duplicates = self._identified(*self._meet(detectors.duplicate(self.edges, self.config.tolerance.duplicate)))
        return self._duplicates

    def _identified(self, found: DataFrame, n: int) -> DataFrame:
        t = self.config.tolerance
        placed = iss.numbered(found, iss.stable_key(t.coordinate_epsilon), detectors.message(t.short_edge), n)  # stored with their positions
        rows = self._described(placed).withColumnRenamed("__counter", "counter").withColumn("issue_id", F.concat_ws("|", "issue_type", "source_keys", F.col("counter").cast("string")))
        return iss.registry(iss.with_display(rows))[0]

    def report(self) -> DataFrame:
        """The profile as one row."""
        t = self.config.tolerance
        one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        return (
            one(self.edges, "edge_count").crossJoin(one(self.vertices, "vertex_count")).crossJoin(profile.nonzero_z(self.edges, t.coordinate_epsilon))
            .crossJoin(profile.z_vertices(self.edges, t.coordinate_epsilon, t.big_z, self.spots)).crossJoin(profile.large_extrema(self.edges, t.large_coordinate))
            .crossJoin(profile.face_totals(self.faces)).crossJoin(self.containers).crossJoin(profile.z_range(self.edges)).crossJoin(one(self.layers, "layer_count"))
        )

    def find(self, issue_id: str) -> DataFrame:
        return self.issues.where(F.col("issue_id") == issue_id).limit(1)

    def as_json(self) -> DataFrame:
        """One JSON document an issue, as a user interface takes them."""
        return self.issues.select("issue_id", F.to_json(F.struct("issue_id", "issue_type", "severity", "confidence", "edge_ids", "source_entity_ids", "sources", "message", "metadata", "locatable", "layer_name", "location", "display_length")).alias("document"))
