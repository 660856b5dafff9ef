"""Universe, phases and cadence, from a dict or a YAML text of the same shape."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .schema import FEATURES_5, SECOND_NS


@dataclass(frozen=True)
class Phase:
    id: int
    name: str
    offset_ns: int
    symbols: tuple[str, ...]


@dataclass(frozen=True)
class Config:
    symbols: tuple[str, ...]
    phases: tuple[Phase, ...]
    cadence_ns: int = SECOND_NS
    max_frames: int = 4096
    features: tuple[str, ...] = field(default_factory=lambda: tuple(FEATURES_5))

    def __post_init__(self) -> None:
        if self.max_frames & (self.max_frames - 1) or self.max_frames <= 0:
            raise ValueError("max_frames must be a power of two")
        if any(not 0 <= p.offset_ns < self.cadence_ns for p in self.phases):
            raise ValueError("a phase's offset must be under the cadence")

    @property
    def full(self) -> bool:
        """Whether frames have the 44 features."""
        return len(self.features) == 44

    def phase_symbols(self, spark: SparkSession) -> DataFrame:
        """phase, offset_ns, symbol: one row for each phase of a symbol."""
        return rows_of(spark, [(p.name, p.id, p.offset_ns, s) for p in self.phases for s in p.symbols], "phase string, phase_id int, offset_ns long, symbol string")

    def universe(self, spark: SparkSession) -> DataFrame:
        return rows_of(spark, [(s, k) for k, s in enumerate(self.symbols)], "symbol string, symbol_index int")


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table held in the plan itself: Spark knows its size, and broadcasts it by that."""
    import pyarrow as pa

    columns = list(zip(*rows)) or [()] * len(schema.split(","))
    names = [c.split()[0] for c in schema.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return spark.createDataFrame(pa.table([pa.array(list(c), kinds[f.split()[1]]) for c, f in zip(columns, schema.split(","))], names=names), schema)


def from_dict(d: dict) -> Config:
    shm = d.get("shm") or {}
    phases = tuple(Phase(int(p.get("id", k)), str(p.get("name", k)), int(p.get("offset_ms", 0)) * 1_000_000, tuple(p.get("symbols") or ())) for k, p in enumerate(d.get("phases") or ()))
    return Config(tuple(d.get("unique_symbols") or ()), phases, int(shm.get("cadence_interval", SECOND_NS)), int(shm.get("max_frames", 4096)), tuple(d.get("features") or FEATURES_5))


def from_yaml(text: str) -> Config:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML configuration needs the yaml package; from_dict takes the same as a dict") from e
    return from_dict(yaml.safe_load(text))
