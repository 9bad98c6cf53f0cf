"""Configuration models: strict, so that a misspelt key is an error and not a column left open."""

from __future__ import annotations

from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, Field, model_validator


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class GlobalSettings(Strict):
    seed: int | str | None = None
    derivation_salt: str | None = None
    post_validation: bool | dict = False
    on_pool_exhaustion: Literal["error", "warn"] = "error"
    fidelity_warn_threshold: float = 0.8
    strict_compat: bool = False


class FileEnd(Strict):
    type: Literal["file", "s3", "gcs"] = "file"
    format: Literal["csv", "parquet", "json", "orc", "ipc"] = "parquet"
    path: str | None = None
    bucket: str | None = None
    key: str | None = None
    object: str | None = None
    region: str | None = None
    endpoint: str | None = None
    options: dict[str, Any] = Field(default_factory=dict)

    def location(self) -> str:
        if self.type == "s3":
            return f"s3a://{self.bucket}/{self.key}"
        if self.type == "gcs":
            return f"gs://{self.bucket}/{self.object}"
        return self.path or ""


class MaskColumn(Strict):
    name: str
    strategy: str
    provider: str | None = None
    namespace: str | None = None
    cardinality_mode: Literal["reuse", "unique", "match_source_cardinality", "scale_source_cardinality"] = "reuse"
    deterministic: bool = True
    scale: float = 2.0
    provider_config: dict[str, Any] = Field(default_factory=dict)
    coherent_with: list[str] = Field(default_factory=list)
    backend_type: str | None = None
    backend_version: str | None = None
    pool_size: int | None = None
    vault: bool = False
    allow_collisions: bool = False
    when: str | None = None


class GenerateColumn(BaseModel):
    model_config = ConfigDict(extra="allow")
    name: str
    type: Literal["sequence", "categorical", "faker", "reference", "formula", "statistical", "distribution"]


class Table(Strict):
    columns: list[MaskColumn] = Field(default_factory=list)
    generate_columns: list[GenerateColumn] = Field(default_factory=list)
    rows: int | None = None
    transforms: list[dict[str, Any]] = Field(default_factory=list)
    row_key: list[str] = Field(default_factory=list)

    @model_validator(mode="after")
    def one_kind(self) -> Table:
        if bool(self.columns) and bool(self.generate_columns):
            raise ValueError("a table masks columns or generates them, not both")
        if self.generate_columns and self.rows is None:
            raise ValueError("a generated table needs rows")
        dropped = {c for t in self.transforms if t.get("op") == "drop_column" for c in ([t["columns"]] if isinstance(t.get("columns"), str) else t.get("columns", []))}
        if both := dropped & {c.name for c in self.columns}:
            raise ValueError(f"masked columns are dropped: {', '.join(sorted(both))}")
        return self


class Relationship(Strict):
    parent_table: str
    parent_columns: list[str]
    child_table: str
    child_columns: list[str]
    namespace: str | None = None
    orphan_policy: str | None = None


class PipelineConfig(Strict):
    version: Literal[1] = 1
    global_settings: GlobalSettings = Field(default_factory=GlobalSettings)
    sources: dict[str, FileEnd] = Field(default_factory=dict)
    tables: dict[str, Table]
    relationships: list[Relationship] = Field(default_factory=list)
    targets: dict[str, FileEnd] = Field(default_factory=dict)
    namespaces: dict[str, list[str]] = Field(default_factory=dict)
    run_storm: bool = False


def override_sources(config: dict, sources: dict[str, dict]) -> dict:
    """The config with other sources; their names must be those of the config."""
    from ..errors import MaskError

    if set(sources) != set(config.get("sources", {})):
        raise MaskError("override_sources_keys", ", ".join(sorted(set(sources) ^ set(config.get("sources", {})))))
    return {**config, "sources": {k: {**config["sources"][k], **v} for k, v in sources.items()}}
