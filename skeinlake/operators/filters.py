"""One law for choosing sessions, used by lists, counts, search and analytics alike."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SessionFilter:
    """What a session must be; None asks for nothing."""

    harnesses: Sequence[str] | None = None
    models: Sequence[str] | None = None
    projects: Sequence[str] | None = None
    paths: Sequence[str] | None = None
    tags: Sequence[str] | None = None
    layer_tags: Sequence[tuple[str, str]] | None = None
    since: int | None = None
    until: int | None = None
    favorite: bool | None = None
    artifact_kinds: Sequence[str] | None = None
    validations: Sequence[str] | None = None
    chain: str | int | None = None
    chain_key: str | None = None
    states: Sequence[str] | None = None
    origins: Sequence[str] | None = None
    hide_agents: bool = False
    visible_only: bool = False
    facet: str | None = None

    def __post_init__(self):
        if self.since is not None and self.until is not None and not self.since < self.until:
            raise ValueError("since must lie before until")


def add_term(chosen: SessionFilter, kind: str, value: str) -> SessionFilter:
    """One more facet or tag; another facet drops the tags chosen under the old one."""
    if kind == "facet":
        return replace(chosen, facet=value, layer_tags=None)
    return replace(chosen, layer_tags=[*(chosen.layer_tags or []), (chosen.facet or "", value)])


def remove_term(chosen: SessionFilter, kind: str, value: str) -> SessionFilter:
    if kind == "facet":
        return replace(chosen, facet=None, layer_tags=None) if chosen.facet == value else chosen
    left = [t for t in chosen.layer_tags or [] if t[1] != value]
    return replace(chosen, layer_tags=left or None)


def _state(name: str) -> Column:
    known = {
        "indexed": F.col("status") == "valid",
        "orphaned": F.col("status") == "orphaned",
        "summarized": F.col("summary").isNotNull(),
        "unsummarized": F.col("summary").isNull(),
        "pending": F.col("job") == "pending",
        "failed": F.col("job") == "failed",
    }
    return known[name]


def apply(
    sessions: DataFrame,
    chosen: SessionFilter,
    tags: DataFrame | None = None,
    favorites: DataFrame | None = None,
    layer_tags: DataFrame | None = None,
    chains: DataFrame | None = None,
) -> DataFrame:
    """The sessions that fit. Side tables: tags (session_id, tag), favorites (harness,
    native_id), layer_tags (session_id, facet, tag, parent), chains (chain, stable_key)."""
    keep = F.lit(True)
    if chosen.visible_only:
        keep = keep & F.col("visible")
    if chosen.harnesses is not None:
        keep = keep & F.col("harness").isin(list(chosen.harnesses))
    if chosen.models is not None:
        wanted = F.array(*[F.lit(m) for m in chosen.models])
        keep = keep & F.arrays_overlap(F.coalesce("models", F.array().cast("array<string>")), wanted)
    if chosen.projects is not None:
        keep = keep & (F.col("project").isin(list(chosen.projects)) | F.col("original_project").isin(list(chosen.projects)))
    if chosen.paths is not None:
        hit = F.lit(False)
        for c in ("cwd", "project", "original_project", "source_path"):
            hit = hit | F.coalesce(F.col(c).isin(list(chosen.paths)), F.lit(False))
        keep = keep & hit
    if chosen.since is not None:
        keep = keep & (F.col("last_activity") >= chosen.since)
    if chosen.until is not None:
        keep = keep & (F.col("last_activity") < chosen.until)
    if chosen.artifact_kinds is not None:
        keep = keep & F.col("artifact_kind").isin(list(chosen.artifact_kinds))
    if chosen.validations is not None:
        keep = keep & F.col("source_validation").isin(list(chosen.validations))
    if chosen.chain is not None:
        test = {"chained": F.col("chain").isNotNull(), "standalone": F.col("chain").isNull()}
        keep = keep & test.get(chosen.chain, F.col("chain") == chosen.chain)
    if chosen.states is not None:
        hit = F.lit(False)
        for s in chosen.states:
            hit = hit | _state(s)
        keep = keep & hit
    if chosen.origins is not None:
        keep = keep & F.col("origin").isin(list(chosen.origins))
    if chosen.hide_agents:
        keep = keep & (F.col("origin").isNull() | (F.col("origin") != "agent"))
    rows = sessions.filter(keep)
    if chosen.tags is not None:
        rows = rows.join(tags.filter(F.col("tag").isin(list(chosen.tags))), "session_id", "left_semi")
    if chosen.chain_key is not None:
        rows = rows.join(chains.filter(F.col("stable_key") == chosen.chain_key).select("chain"), "chain", "left_semi")
    if chosen.favorite is not None:
        rows = rows.join(favorites, ["harness", "native_id"], "left_semi" if chosen.favorite else "left_anti")
    if chosen.layer_tags is not None:
        spark = sessions.sparkSession
        wanted = F.broadcast(spark.createDataFrame(list(chosen.layer_tags), "facet string, wanted string"))
        either = layer_tags.join(wanted, ["facet"]).filter((F.col("tag") == F.col("wanted")) | (F.col("parent") == F.col("wanted")))
        rows = rows.join(either, "session_id", "left_semi")
    return rows
