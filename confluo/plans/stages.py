"""The stages of the whole fusion, their inputs, and a runner."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    queries: tuple[str, ...]


#: One explicit order; what a stage needs is a table of the data set or given by an earlier stage.
STAGES = (
    Stage("ingest", ("events",), ("daily",), ("day_kst_sum", "complete_days", "sentinel_clean")),
    Stage("regrid", ("events",), ("grid",), ("regrid_bilinear_nan", "gap_interpolate_linear")),
    Stage("sm2rain", ("events",), ("rain",), ("sm2rain_grid_calibrate", "sm2rain_forward")),
    Stage("tca", ("events",), ("merged",), ("tca_weights", "tca_merge")),
    Stage("correct", ("events",), ("corrected",), ("ols_single", "ols_apply", "ratio_guided_fill")),
    Stage("basin", ("events",), ("basins",), ("thiessen_weights", "thiessen_mean", "area_weighted_basin")),
    Stage("evaluate", ("lineitem",), ("scores",), ("metrics_full", "by_season_year_grouping_sets", "basin_evaluate")),
    Stage("export", ("events",), ("exports",), ("basin_info", "excluded_basins", "cell_coordinates", "thiessen_weights_export", "export_diagnostics")),
)


def resolve(name: str, stages: Sequence[Stage] = STAGES) -> Stage:
    """A stage by its name, else by the beginning of it, else by a part; the first that fits."""
    for fits in (str.__eq__, str.startswith, str.__contains__):
        for s in stages:
            if fits(s.name, name):
                return s
    raise ValueError(f"no stage {name!r}")


def missing_inputs(stage: Stage, exists: Callable[[str], bool]) -> list[str]:
    return [t for t in stage.needs if not exists(t)]


def select(names: Sequence[str], start: str | None) -> list[Stage]:
    chosen = [resolve(n) for n in names] or list(STAGES)
    return chosen if start is None else list(STAGES[STAGES.index(resolve(start)) :])


def _exists(spark: SparkSession, sf_dir: str) -> Callable[[str], bool]:
    """Whether a table of the data set is there."""

    def there(table: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    return there


def run(spark: SparkSession, sf_dir: str, out: str, stages: Sequence[Stage], dry: bool = False, force: bool = False) -> list[str]:
    """Runs stages in order and writes a table for each query; a stage whose inputs are absent is passed over."""
    from . import registry

    registry.load()
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    exists = lambda p: fs(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(p))
    done = []
    for s in stages:
        if missing_inputs(s, _exists(spark, sf_dir)):
            continue
        for q in s.queries:
            if not dry and (force or not exists(f"{out}/{q}")):
                registry.QUERIES[q](spark, sf_dir).write.mode("overwrite").parquet(f"{out}/{q}")
            done.append(q)
    return done


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stages", nargs="*")
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--from", dest="start")
    for flag in ("dry", "force", "list", "check"):
        p.add_argument(f"--{flag}", action="store_true")
    a = p.parse_args(args)
    chosen = select(a.stages, a.start)
    if a.list:
        print("\n".join(f"{s.name}: {', '.join(s.queries)}" for s in chosen))
        return
    spark = SparkSession.builder.appName("confluo").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.check:
        print("\n".join(f"{s.name}: {', '.join(missing_inputs(s, _exists(spark, a.data))) or 'complete'}" for s in chosen))
        return
    print("\n".join(run(spark, a.data, a.out, chosen, a.dry, a.force)))


if __name__ == "__main__":
    main()
