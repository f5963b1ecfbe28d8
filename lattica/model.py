"""The bundle of DataFrames that stands for one annotated matrix collection, and schema checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Columns each table must have.
SCHEMAS = {
    "expr": ("slice", "obs_id", "gene", "value"),
    "obs": ("slice", "obs_id"),
    "var": ("slice", "gene"),
    "emb": ("obs_id", "vec"),
    "edges": ("src", "dst", "w"),
    "comp": ("obs_id", "cell_type", "value"),
    "ppi": ("gene1", "gene2", "combined_score"),
}


def require(df: DataFrame, table: str) -> DataFrame:
    """df itself, or a ValueError that names the columns of `table` it lacks."""
    missing = [c for c in SCHEMAS[table] if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the columns {missing}; it has {df.columns}")
    return df


@dataclass
class Bundle:
    """expr is long-format and holds no zeros; obs has every observation, also those without counts."""

    expr: DataFrame
    obs: DataFrame
    var: DataFrame | None = None
    emb: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    comp: dict[str, DataFrame] = field(default_factory=dict)
    #: Raw counts beside normalised ones in expr.
    counts: DataFrame | None = None

    def __post_init__(self) -> None:
        require(self.expr, "expr")
        require(self.obs, "obs")
