"""Layers of analysis as a registry: users add theirs, and one that fails does not end the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.schema import FINDING
from ..operators import metadata, scoring, trace
from ..operators.similarity import POPULAR
from ..sources.files import CANARIES
from ..sources.rules import Rule, load
from ..sources.shared import written
from . import orchestrate

#: What places of findings are shifted by from layer to layer.
LAYER_STEP = 10_000_000


@dataclass(frozen=True)
class Layer:
    """``analyze`` takes the inputs that ``needs`` names and gives findings, in any order of columns."""

    name: str
    needs: tuple[str, ...]
    analyze: Callable[..., DataFrame]


@dataclass
class Layers:
    """Layers in the order in which their findings are listed."""

    layers: list[Layer] = field(default_factory=list)

    def register(self, layer: Layer) -> Layers:
        """Add a layer, or put another in the place of that of its name."""
        names = [x.name for x in self.layers]
        if layer.name in names:
            self.layers[names.index(layer.name)] = layer
        else:
            self.layers.append(layer)
        return self

    def run(self, spark: SparkSession, inputs: dict[str, object]) -> tuple[DataFrame, DataFrame]:
        """Findings of all layers that ran, and layer, status and n_findings of every layer.

        A status is ``ran``, ``no input`` or ``failed: <why>``. Each layer is computed on its own and
        written once; its columns must be those of findings, of types that can become theirs.
        """
        kind, status, out = StructType.fromDDL(FINDING), [], spark.createDataFrame([], FINDING)
        for rank, layer in enumerate(self.layers):
            if any(inputs.get(n) is None for n in layer.needs):
                status.append((layer.name, "no input", 0))
                continue
            try:
                found = layer.analyze(**{n: inputs[n] for n in layer.needs})
                if missing := [c for c in kind.names if c not in found.columns]:
                    raise ValueError(f"findings without {', '.join(missing)}")
                found = written(found.withColumn("package_id", F.col("package_id").cast("string")).to(kind))
                status.append((layer.name, "ran", found.count()))
            except Exception as wrong:  # whatever a user's layer raises
                status.append((layer.name, f"failed: {type(wrong).__name__}", 0))
                continue
            out = out.unionByName(found.withColumn("finding_seq", F.col("finding_seq") + rank * LAYER_STEP))
        return out, spark.createDataFrame(status, "layer string, status string, n_findings long")

    def judge(self, spark: SparkSession, packages: DataFrame, inputs: dict[str, object]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Findings, verdicts of all ``packages`` (package_id), and the layers' status."""
        found, status = self.run(spark, inputs)
        return found, scoring.verdicts(found, packages.select(F.col("package_id").cast("string"))), status


def standard(rules: list[Rule] | None = None, as_of: datetime | None = None, popular: DataFrame | None = None) -> Layers:
    """The built-in layers: static (files), metadata (packages) and sandbox (lines)."""

    def of_metadata(packages: DataFrame) -> DataFrame:
        if as_of is None:
            raise ValueError("metadata checks need as_of")
        names = popular if popular is not None else packages.sparkSession.createDataFrame([(n,) for n in POPULAR], "name string")
        return metadata.analyze(packages, names, as_of)

    known = rules if rules is not None else load().rules
    return Layers([
        Layer("static", ("files",), lambda files: orchestrate.static_findings(files, known)),
        Layer("metadata", ("packages",), of_metadata),
        Layer("sandbox", ("lines",), lambda lines: trace.parse(lines, list(CANARIES))),
    ])
