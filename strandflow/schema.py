"""Fixed schemas of the engine's tables. All computing is in DOUBLE; what is undefined is NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame



SCHEMAS = {
    "trajectory": "run_id string, frame int, atom_id int, x double, y double, z double",
    "atoms": "run_id string, atom_id int, atom_type string, is_backbone boolean",
    "group_atoms": "kind string, group_id int, atom_id int",
    "frame_features": "run_id string, frame int, rmsd double, rg double, com_x double, com_y double, com_z double",
    "events": "run_id string, event_id int, start_frame int, end_frame int, type string, score double",
    "links": "event_id int, link_type string, from_id int, to_id int, strength double, lag int, distance double, sync_rate double",
    "kv": "run_id string, frame int, cluster_id int, kv_ratio double",
}


def check(df: DataFrame, table: str) -> DataFrame:
    """df if it has the table's columns with their types, in any order; else ValueError names the first that differs."""
    have = dict(df.dtypes)
    for field in SCHEMAS[table].split(","):
        name, kind = field.split()
        if have.get(name) != kind:
            raise ValueError(f"{table}: column {name} must be {kind}, not {have.get(name)}")
    return df
