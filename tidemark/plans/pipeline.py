"""Processing graphs: named stages of DataFrame -> DataFrame, built once, shown, run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Stage = Callable[..., DataFrame]


@dataclass
class Graph:
    """Stages by name, each with the names of its inputs; Catalyst does the rest."""

    stages: dict[str, tuple[Stage, tuple[str, ...]]] = field(default_factory=dict)

    def add(self, name: str, stage: Stage, *inputs: str) -> Graph:
        if name in self.stages:
            raise ValueError(f"there is a stage {name!r} already")
        self.stages[name] = (stage, inputs)
        return self

    def build(self, sources: dict[str, DataFrame], sinks: list[str] | None = None) -> dict[str, DataFrame]:
        """The results of the sinks (or of the stages that feed no other)."""
        made = dict(sources)

        def need(name: str, above: tuple[str, ...] = ()) -> DataFrame:
            if name in above:
                raise ValueError(f"a circle: {' -> '.join((*above, name))}")
            if name not in made:
                if name not in self.stages:
                    raise KeyError(f"no stage or source {name!r}")
                stage, inputs = self.stages[name]
                made[name] = stage(*[need(i, (*above, name)) for i in inputs])
            return made[name]

        used = {i for _, inputs in self.stages.values() for i in inputs}
        return {n: need(n) for n in (sinks or [n for n in self.stages if n not in used])}

    def dump(self) -> str:
        """A line for each stage: its inputs, and its name."""
        return "\n".join(f"{', '.join(inputs) or '-'} -> {name}" for name, (_, inputs) in self.stages.items())


def scans(df: DataFrame) -> list[str]:
    """The file scans of a plan with what they read and push down, as explain shows them."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in text.splitlines() if "FileScan" in line]
