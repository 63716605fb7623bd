"""Table schemas, snapshots and patterns of a site graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPE_DECL = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("site_idx", T.IntegerType()),
        T.StructField("site_name", T.StringType()),
        T.StructField("allowed_states", T.ArrayType(T.StringType())),
    ]
)
NODE = T.StructType([T.StructField("node_id", T.LongType()), T.StructField("type", T.StringType())])
SITE = T.StructType(
    [
        T.StructField("node_id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("site_idx", T.LongType()),
        T.StructField("site_name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("partner_node", T.LongType()),
        T.StructField("partner_site", T.LongType()),
    ]
)
EDIT = T.StructType(
    [
        T.StructField("edit_id", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("site_idx", T.LongType()),
        T.StructField("new_state", T.StringType()),
        T.StructField("partner_node", T.LongType()),
        T.StructField("partner_site", T.LongType()),
    ]
)
SITE_COLS = SITE.fieldNames()


@dataclass
class Snapshot:
    """One state of a site graph.

    ``nodes`` has a row per live node, ``sites`` a row per site with the node's type repeated so that a type
    filter reaches the scan. ``partner_node``/``partner_site`` are null on a free site and mirrored on both
    ends of a link. Where the source of the graph knows both ends of a link in one row, ``ends`` holds the linked sites
    with ``far_type``, ``far_name`` and ``far_state`` of the site at the other end, which saves joining them.
    """

    nodes: DataFrame
    sites: DataFrame
    _n_sites: int | None = field(default=None, repr=False)
    ends: DataFrame | None = field(default=None, repr=False)

    def n_sites(self) -> int:
        """Number of sites, counted once; decides whether any node can be a hub at all."""
        if self._n_sites is None:
            self._n_sites = self.sites.count()
        return self._n_sites

    def links(self) -> DataFrame:
        """Each link once, lower end first; a link from a node to itself is ordered by site."""
        once = (F.col("node_id") < F.col("partner_node")) | (
            (F.col("node_id") == F.col("partner_node")) & (F.col("site_idx") < F.col("partner_site"))
        )
        return self.sites.filter(F.col("partner_node").isNotNull() & once).select(
            F.col("node_id").alias("node_a"),
            F.col("site_idx").alias("site_a"),
            F.col("partner_node").alias("node_b"),
            F.col("partner_site").alias("site_b"),
        )


def snapshot_from_links(nodes: DataFrame, sites: DataFrame, links: DataFrame) -> Snapshot:
    """Join a link table that names each link once onto a site table without partner columns."""
    ends = links.select(
        F.col("node_a").alias("node_id"),
        F.col("site_a").alias("site_idx"),
        F.col("node_b").alias("partner_node"),
        F.col("site_b").alias("partner_site"),
    ).unionByName(
        links.select(
            F.col("node_b").alias("node_id"),
            F.col("site_b").alias("site_idx"),
            F.col("node_a").alias("partner_node"),
            F.col("site_a").alias("partner_site"),
        )
    )
    return Snapshot(nodes, sites.join(ends, ["node_id", "site_idx"], "left").select(*SITE_COLS))


@dataclass(frozen=True)
class Slot:
    """One site of a pattern node.

    ``bond`` is "any" (don't care), "free", "bound", or an integer label shared by the two ends of a pattern
    bond. ``state`` None is don't care. A ``loose`` name also fits sites named like it without its digits at the end, so that
    numbered names tell alike sites of one node apart.
    """

    name: str
    state: str | None = None
    bond: str | int = "any"
    loose: bool = False

    @property
    def family(self) -> str:
        """Slots of one node that may fall on the same site have the same family."""
        return self.name.rstrip("0123456789") if self.loose else self.name

    def named(self) -> Column:
        return F.col("site_name").isin(self.name, self.family) if self.loose else F.col("site_name") == self.name

    def predicate(self) -> Column:
        keep = self.named()
        if self.state is not None:
            keep = keep & (F.col("state") == self.state)
        if self.bond == "free":
            keep = keep & F.col("partner_node").isNull()
        elif self.bond != "any":
            keep = keep & F.col("partner_node").isNotNull()
        return F.coalesce(keep, F.lit(False))


@dataclass(frozen=True)
class Mol:
    type: str
    slots: tuple[Slot, ...] = ()

    def __post_init__(self):
        if len({s.loose for s in self.slots}) > 1:
            raise ValueError("the names of one node are all loose or all strict")


def mol(type_name: str, *slots: Slot) -> Mol:
    return Mol(type_name, tuple(slots))


@dataclass(frozen=True)
class Pattern:
    """Pattern nodes, the first of which is the seed, with an optional match-count condition per complex."""

    mols: tuple[Mol, ...]
    relation: str | None = None
    quantity: int = 0

    def bonds(self) -> list[tuple[tuple[int, int], tuple[int, int]]]:
        """Pairs of (pattern node, slot) that share an integer label."""
        ends: dict[int, list[tuple[int, int]]] = {}
        for i, m in enumerate(self.mols):
            for j, s in enumerate(m.slots):
                if isinstance(s.bond, int):
                    ends.setdefault(s.bond, []).append((i, j))
        bad = [label for label, e in ends.items() if len(e) != 2]
        if bad:
            raise ValueError(f"bond labels {bad} are not on exactly two sites")
        return [(e[0], e[1]) for e in ends.values()]

    def neighbours(self) -> dict[int, set[int]]:
        near: dict[int, set[int]] = {i: set() for i in range(len(self.mols))}
        for (a, _), (b, _) in self.bonds():
            near[a].add(b)
            near[b].add(a)
        return near

    def fragments(self) -> list[list[int]]:
        """Groups of pattern nodes joined by pattern bonds, in breadth-first order from their first node."""
        near, left, out = self.neighbours(), list(range(len(self.mols))), []
        while left:
            order = [left[0]]
            for node in order:
                order += sorted(near[node] - set(order))
            out.append(order)
            left = [i for i in left if i not in order]
        return out

    def diameter(self) -> int:
        """Longest shortest path over pattern bonds, counted in bonds."""
        near, far = self.neighbours(), 0
        for start in near:
            depth, frontier, seen = 0, {start}, {start}
            while True:
                frontier = {n for f in frontier for n in near[f]} - seen
                if not frontier:
                    break
                seen |= frontier
                depth += 1
            far = max(far, depth)
        return far


def pattern(*mols: Mol, relation: str | None = None, quantity: int = 0) -> Pattern:
    return Pattern(tuple(mols), relation, quantity)


@dataclass(frozen=True)
class Observable:
    """``kind`` is "Molecules" (all embeddings) or "Species" (complexes with a match)."""

    name: str
    kind: str
    patterns: tuple[Pattern, ...]


def observable(name: str, kind: str, *patterns: Pattern) -> Observable:
    if kind not in ("Molecules", "Species"):
        raise ValueError(f"unknown observable kind {kind!r}")
    return Observable(name, kind, tuple(patterns))
