"""Settings of users as JSON texts: each field has a default, and a text that cannot be read has all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Versions

# Sizes of a window, least, most and default.
SIZES = {"width": ("Width", 820.0, 10000.0, 900.0), "height": ("Height", 520.0, 10000.0, 560.0)}
#: Switches of ranking and their defaults.
SWITCHES = {"behavior_enabled": "BehaviorEnabled", "local_model_enabled": "LocalModelEnabled", "cloud_enabled": "CloudEnabled"}
DEFAULTS = {"width": 900.0, "height": 560.0, "maximized": False, "behavior_enabled": True, "local_model_enabled": True, "cloud_enabled": True, "behavior_disclosure": False}


def read(rows: DataFrame, column: str = "json") -> DataFrame:
    """The rows with a column for each setting. No text, a text that is not a JSON object, and one with a size that is no number
    or a ``Maximized`` that is no boolean give all defaults; any other odd field gives its own. Sizes below
    the least give the default, beyond the most the most."""
    whole = F.try_parse_json(column)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(whole, path, "variant"))
    number = lambda path: kind(path).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
    absent = lambda path: F.try_variant_get(whole, path, "variant").isNull()
    boolean = lambda path: kind(path) == "BOOLEAN"
    good = F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")) & (absent("$.Maximized") | boolean("$.Maximized"))
    for path, *_ in SIZES.values():
        good = good & (absent(f"$.{path}") | number(f"$.{path}"))
    good = F.coalesce(good, F.lit(False))

    def size(path: str, least: float, most: float, default: float) -> Column:
        value = F.try_variant_get(whole, f"$.{path}", "double")
        return F.when(good & (value >= least) & (value < float("inf")), F.least(value, F.lit(most))).otherwise(default)

    def switch(path: str, default: bool) -> Column:
        return F.when(good & F.coalesce(boolean(path), F.lit(False)), F.try_variant_get(whole, path, "boolean")).otherwise(default)

    return rows.withColumns(
        {name: size(*spec) for name, spec in SIZES.items()}
        | {"maximized": switch("$.Maximized", False), "behavior_disclosure": switch("$.BehaviorDisclosureAcknowledged", False)}
        | {name: switch(f"$.Ranking.{key}", DEFAULTS[name]) for name, key in SWITCHES.items()}
    )


class SettingsStore:
    """Settings of one user below ``root``: each save is a decision of one writer, and the newest counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.versions = Versions(spark, root)

    def load(self) -> dict:
        return DEFAULTS | self.versions.latest()[1]

    def save(self, **changed) -> int:
        """Adds changed settings to those stored; unknown names raise. A writer that another overtakes gets a Conflict."""
        if unknown := set(changed) - set(DEFAULTS):
            raise ValueError(f"INVALID_ARGUMENTS: {sorted(unknown)}")
        number, now = self.versions.latest()
        self.versions.propose(number + 1, **(now | changed))
        return number + 1


def error_object(code: Column, message: Column, action: Column) -> Column:
    """What is written in place of a result that failed."""
    return F.to_json(F.struct(code.alias("code"), message.alias("message"), action.alias("correctiveAction")))


def exit_code(code: Column) -> Column:
    """0 without an error, 2 for arguments that make no sense, 1 for all else."""
    return F.when(code.isNull(), 0).when(code == "INVALID_ARGUMENTS", 2).otherwise(1)
